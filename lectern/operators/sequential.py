"""Operators with state inside one document or word: stems, pair stacks, edits, diffs, wrapping, suggestions.

Each runs as an Arrow batch function over rows that do not depend on each other (a document, a distinct word), so
none needs a shuffle except where findings are grouped by document.
"""

from __future__ import annotations

import difflib
import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.dialect import WORD
from lectern.operators import tokens
from lectern.session import table

_VOWELS = "aeiou"


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in _VOWELS and not (c == "y" and i > 0 and out[i - 1]))
    return out


def _measure(word: str) -> int:
    kinds = _consonants(word)
    return sum(not a and b for a, b in zip(kinds, kinds[1:], strict=False))


def _short_end(word: str) -> bool:
    k = _consonants(word)
    return len(word) >= 3 and k[-3:] == [True, False, True] and word[-1] not in "wxy"


def _first(word: str, rules: tuple[tuple[str, str], ...], at_least: int) -> str:
    for end, new in rules:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem + new if _measure(stem) >= at_least else word
    return word


# The suffix tables of Porter's published algorithm (1980), with "bli" and "logi" of its later errata.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def stem(word: str) -> str:
    """Porter's stem of a lower-case word; words of up to two letters stay."""
    if len(word) <= 2:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and not all(_consonants(word[: -len(end)])):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _short_end(word)):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1] and word[-1] not in "lsz":
                    word = word[:-1]
                break
    if word.endswith("y") and not all(_consonants(word[:-1])):
        word = word[:-1] + "i"
    word = _first(_first(word, _STEP2, 1), _STEP3, 1)
    for end in _STEP4:
        if word.endswith(end):
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def _column(f: Callable, kind: str):
    return F.pandas_udf(lambda s: s.map(f), kind)


@lru_cache(maxsize=1 << 18)
def _stem(word: str) -> str:
    return stem(word)


def repeated_stems(docs: DataFrame, reach: int = 3) -> DataFrame:
    """Words whose stem came among the last ``reach`` of their sentence; a worker stems a word once while it remembers it."""
    return tokens.near_stems(docs, _stem, reach)


_CLOSE = {")": "(", "]": "[", "}": "{"}


def unclosed(text: str | None) -> list[int]:
    """Positions of brackets without a partner; a closing one takes the nearest open one of its kind."""
    open_now: list[tuple[str, int]] = []
    lone: list[int] = []
    for i, c in enumerate(text or ""):
        if c in "([{":
            open_now.append((c, i))
        elif c in _CLOSE:
            k = next((k for k in range(len(open_now) - 1, -1, -1) if open_now[k][0] == _CLOSE[c]), None)
            if k is None:
                lone.append(i)
            else:
                del open_now[k]
    return sorted([*lone, *(i for _, i in open_now)])


def pairs(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", F.explode(_column(unclosed, "array<bigint>")(F.col("text"))).alias("start"), "text")
    return found.select("doc_id", "start", F.substring("text", F.col("start").cast("int") + 1, F.lit(1)).alias("output"), F.lit("W").alias("severity"))


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, int, int]:
    """The text after as many non-overlapping edits as can be (earliest end first), and how many were kept and left."""
    todo = sorted(set(edits), key=lambda e: (e[1], e[0], e[2]))
    kept, at = [], -1
    for a, b, new in todo:
        if a >= max(at, 0):
            kept.append((a, b, new))
            at = b
    for a, b, new in reversed(kept):
        text = text[:a] + new + text[b:]
    return text, len(kept), len(todo) - len(kept)


def edit_documents(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited texts of ``docs(doc_id, text)`` by ``edits(doc_id, start, end, replacement)``, with a unified diff."""
    listed = edits.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "replacement")).alias("edits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text, own in b.itertuples(index=False, name=None):
                new, kept, left = apply_edits(text or "", [(e["start"], e["end"], e["replacement"] or "") for e in own])
                diff = "".join(difflib.unified_diff((text or "").splitlines(True), new.splitlines(True), "a", "b", n=3))
                rows.append((i, new, kept, left, diff))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "kept", "conflicts", "diff"])

    return docs.select("doc_id", "text").join(listed, "doc_id").mapInPandas(run, "doc_id long, text string, kept long, conflicts long, diff string")


#: Characters of paragraphs that are wrapped in one step.
REFLOW_SLICE = 1_000_000


def _wrapped(own: list[list[str]], widths: range) -> Iterator[str]:
    """Paragraphs, given as their words, at their best width: all paragraphs and widths take their next line at once."""
    count = np.array([len(w) for w in own])
    # Where each word begins if all words of all paragraphs stand in one line, with a space after each.
    edge = np.concatenate(([0], np.cumsum(np.fromiter((len(w) + 1 for words in own for w in words), np.int64, int(count.sum())))))
    stop = np.cumsum(count)
    shape = len(own), len(widths)
    lines, total, squares, longest = (np.zeros(shape, np.int64).ravel() for _ in range(4))
    end, width = np.repeat(stop, shape[1]), np.tile(np.array(widths), shape[0])
    at, live = np.repeat(stop - count, shape[1]), np.arange(len(end))
    while len(live):
        # A word that is longer than the line has one of its own.
        after = np.minimum(np.maximum(np.searchsorted(edge, edge[at] + width[live] + 1, "right") - 1, at + 1), end[live])
        size = edge[after] - 1 - edge[at]
        longest[live] = np.maximum(longest[live], size)
        more = after < end[live]
        live, at, size = live[more], after[more], size[more]
        lines[live] += 1
        total[live] += size
        squares[live] += size * size
    if int(longest.max()) ** 2 * int(lines.max() + 1) > 2**53:
        lines, total, squares, longest = (x.astype(object) for x in (lines, total, squares, longest))
    cost = (lines * longest * longest - 2 * longest * total + squares) / np.maximum(lines, 1)
    best, places = cost.reshape(shape).argmin(axis=1), edge.tolist()
    for words, begin, last, w in zip(own, (stop - count).tolist(), stop.tolist(), best.tolist(), strict=True):
        out, a = [], begin
        while a < last:
            b = min(max(bisect_right(places, places[a] + widths[w] + 1) - 1, a + 1), last)
            out.append(" ".join(words[a - begin : b - begin]))
            a = b
        yield "\n".join(out)


def reflow_all(paragraphs: Iterable[str | None], widths: range = range(70, 110)) -> list[str | None]:
    """Each paragraph wrapped at the width whose lines differ least in length, the last line aside; short ones stay."""
    out = list(paragraphs)
    todo = [i for i, p in enumerate(out) if p and len(p) >= widths.start]
    while todo:
        n = max(1, int(np.searchsorted(np.cumsum([len(out[i]) for i in todo]), REFLOW_SLICE, "right")))
        part, todo = todo[:n], todo[n:]
        own = [out[i].split() for i in part]
        full = [(i, words) for i, words in zip(part, own, strict=True) if words]
        for i in part:
            out[i] = ""
        if full:
            for (i, _), text in zip(full, _wrapped([words for _, words in full], widths), strict=True):
                out[i] = text
    return out


def reflow(paragraph: str | None, widths: range = range(70, 110)) -> str | None:
    return reflow_all([paragraph], widths)[0]


#: Words that look in one step for their closest ones, and how many times as many those are taken from.
SUGGEST_BLOCK, KNOWN_BLOCKS = 8000, 25
_SLOTS = 64
#: Shares of letters from which on words are compared: the next one only if the ones before leave less than enough that score as much.
_LEVELS, _AT_FIRST = (0.9, 0.87, 0.84, 0.81, 0.78, 0.75, 0.68), 0.75
#: Longer words have no common letters counted in order, as a word's places are the bits of a number.
_BITS = 63


def _letters(words: list[str]) -> np.ndarray:
    """Letters of each word by slot; slots shared by letters only raise the overlap of two words."""
    out = np.zeros((len(words), _SLOTS), np.int32)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    np.add.at(out, (owner, np.fromiter((ord(c) % _SLOTS for w in words for c in w), np.int64, len(owner))), 1)
    return out


class _Known:
    """Words with what bounds their ratio to another word: letters they share, and letters they share in order."""

    def __init__(self, known: list[str]) -> None:
        self.words, self.size = known, np.array([len(k) for k in known], np.int64)
        have = _letters(known)
        # A column says whether a word has a letter so many times; seldom ones are left out, as if all words had them.
        self.columns = [(s, c) for s in range(_SLOTS) for c in range(1, int(have[:, s].max(initial=0)) + 1) if (have[:, s] >= c).mean() > 0.03]
        self.has = self.marks(have)
        self.code = {c: i for i, c in enumerate(sorted({c for k in known for c in k}), 1)}
        width = min(int(self.size.max(initial=0)), _BITS)
        self.letters = np.zeros((width, len(known)), np.int32)
        for i, k in enumerate(known):
            self.letters[: min(len(k), width), i] = [self.code[c] for c in k[:width]]

    def marks(self, have: np.ndarray) -> np.ndarray:
        return np.stack([have[:, s] >= c for s, c in self.columns], axis=1).astype(np.float32) if self.columns else np.zeros((len(have), 0), np.float32)

    def in_order(self, word: str, at: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of a word with each at these places (bit-parallel), or a bound of it."""
        if len(word) > _BITS:
            return np.minimum(self.size[at], len(word))
        bit = np.zeros(len(self.code) + 1, np.uint64)
        for j, c in enumerate(word):
            if c in self.code:
                bit[self.code[c]] |= np.uint64(1 << j)
        v = np.full(len(at), 2**64 - 1, np.uint64)
        for row in self.letters[: int(self.size[at].max(initial=0))]:
            u = v & bit[row[at]]
            v = (v + u) | (v - u)
        common = len(word) - np.bitwise_count(v & np.uint64((1 << len(word)) - 1)).astype(np.int64)
        return np.where(self.size[at] > _BITS, np.minimum(self.size[at], len(word)), common)


def _closest(words: list[str], known: list[str], n: int, cutoff: float) -> Iterator[tuple[str, str, float]]:
    """The ``n`` best of ``known`` for each word; only those are compared whose common letters allow a ratio that counts."""
    of = _Known(known)
    levels = [*(x for x in _LEVELS if x > cutoff), cutoff]
    first = min((x for x in _LEVELS if x >= _AT_FIRST and x > cutoff), default=cutoff)
    for k in range(0, len(words), 64):
        group = words[k : k + 64]
        mine = of.marks(_letters(group))
        for word, share, own in zip(group, mine @ of.has.T, mine.sum(axis=1).tolist(), strict=True):
            matcher, best, done = difflib.SequenceMatcher(), [], np.inf
            matcher.set_seq2(word)
            total = of.size + len(word)
            # Letters without a column may all be shared; first only the words whose share allows a high ratio are looked at.
            at = np.flatnonzero(share >= (first / 2 * total - (len(word) - own) - 1e-6))
            limit = 2 * (share[at] + (len(word) - own)) / np.maximum(total[at], 1)
            for level in levels:
                if level < first and done >= first:
                    at = np.flatnonzero(share >= (cutoff / 2 * total - (len(word) - own) - 1e-6))
                    limit = 2 * (share[at] + (len(word) - own)) / np.maximum(total[at], 1)
                here = at[(limit >= level) & (limit < done)]
                done = level
                bound = 2.0 * of.in_order(word, here) / np.maximum(total[here], 1)
                near = np.flatnonzero(bound >= max(cutoff, best[0][0] if len(best) == n else 0))
                near = near[np.argsort(-bound[near], kind="stable")]
                for i, most in zip(here[near].tolist(), bound[near].tolist(), strict=True):
                    if len(best) == n and most < best[0][0]:
                        break
                    if known[i] == word:
                        continue
                    matcher.set_seq1(known[i])
                    if (score := matcher.ratio()) >= cutoff:
                        (heapq.heappush if len(best) < n else heapq.heappushpop)(best, (score, known[i]))
                if len(best) == n and best[0][0] >= level:
                    break
            yield from ((word, k, score) for score, k in best)


def suggestions(words: DataFrame, lexicon: DataFrame, n: int = 5, cutoff: float = 0.6) -> DataFrame:
    """The closest other lexicon words of each word, as ``difflib.get_close_matches`` over the whole lexicon gives them."""

    def packed(df: DataFrame, name: str, size: int, least: int = 0) -> DataFrame:
        one = df.select("word").where("word is not null").distinct()
        count = one.count()
        blocks = max(1, -(-count // size), min(least, count // 500))
        return one.groupBy(F.pmod(F.xxhash64("word"), F.lit(blocks)).alias(f"_{name}")).agg(F.collect_list("word").alias(name)).repartitionByRange(min(blocks, 1000), f"_{name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = list(zip(*_closest(b.column(0)[i].as_py(), b.column(1)[i].as_py(), n, cutoff), strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.float64())], names=["word", "known", "score"])

    words.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)
    # Pairs of blocks are dealt to tasks, each as many as there are blocks of words: none is broadcast.
    scored = packed(words, "words", SUGGEST_BLOCK, 64).hint("shuffle_replicate_nl").crossJoin(packed(lexicon, "lexicon", SUGGEST_BLOCK * KNOWN_BLOCKS)).select("words", "lexicon").mapInArrow(run, "word string, known string, score double")
    # Ties go to the later word, as there.
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), F.desc("known")))).where(F.col("rank") <= n)
    return best.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "known"))).alias("s")).select("word", F.transform("s", lambda x: x["known"]).alias("suggestions"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _space_edits(docs: DataFrame) -> DataFrame:
    """Two edits at the head of each text, overlapping in longer ones."""
    n = F.length("text").cast("bigint")
    one = docs.where("text is not null").select("doc_id", F.lit(0).cast("bigint").alias("start"), F.least(n, F.lit(5)).cast("bigint").alias("end"), F.lit("Start").alias("replacement"))
    return one.unionByName(docs.where("length(text) > 9").select("doc_id", F.lit(3).cast("bigint").alias("start"), F.lit(8).cast("bigint").alias("end"), F.lit("x").alias("replacement")))


def _suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every word of the documents, the closest other words of their lexicon."""
    lexicon = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0)).alias("word")).distinct()
    return suggestions(lexicon, lexicon)


QUERIES = {
    "repeated_stem": lambda spark, sf: repeated_stems(_docs(spark, sf)),
    "pairs_stack": lambda spark, sf: pairs(_docs(spark, sf)),
    "edit_conflict": lambda spark, sf: edit_documents(_docs(spark, sf), _space_edits(_docs(spark, sf))),
    "reflow": lambda spark, sf: _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("para_ix", "para")).select("doc_id", "para_ix", F.pandas_udf(lambda s: pd.Series(reflow_all(s), dtype=object), "string")("para").alias("wrapped")),
    "spelling_suggestions": _suggested,
}
