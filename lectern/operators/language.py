"""Language rules beyond the portable ones: rules with lookaround, abbreviations, collocations, clauses, line ends.

Patterns here run in the JVM's regex engine, which has the lookaround that portable patterns must avoid.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import vocabulary as v
from lectern.functions.dialect import WORD
from lectern.operators import tokens
from lectern.operators.findings import slices
from lectern.session import stored, table

_W = r"[\p{L}\p{N}_]"
#: Rules by tool and name; each match is a finding.
LOOKAROUND = {
    "mark": {
        "double": r"(?<![,;:!?.])(?:([,;:])\1|(?<!\.)\.\.(?!\.)|\.{4,})(?![,;:])",
        "puncspacestart": r"(?<=[\p{L}\p{N}]) [,;:!?](?=[ \n]|$)",
        "unbracket": rf"(?<={_W})\((?!s\))|\)(?={_W})",
        "aposspace": r"(?<=\p{L})['’] (?=s\b)",
        "closesol": r"(?<=\n)[)\]},;:!?]",
        "openeol": r"[(\[{](?=\n)",
        "puncspaceend": r"(?<=\p{Ll})\.(?=\p{Lu}\p{Ll})|(?<=\p{L}),(?=\p{L})",
    },
    "number": {
        "digitsep": r"(?<![\p{L}\p{N}.,])\p{N}{4,}(?![\p{L}\p{N}])",
        "digitsepless": r"(?<![\p{N}.,])\p{N}{1,3},\p{N}{1,2}(?!\p{N})",
        "digitsepzero": r"(?<![\p{N}.,])0,\p{N}+",
        "lowdigit": r"(?<![\p{L}\p{N}.,:/\-])(?:1[0-2]|[0-9])(?= \p{Ll}{3,})",
        "nozero": r"(?<![\p{L}\p{N}.])\.\p{N}",
        "zeronodot": r"(?<![\p{L}\p{N}.,])0\p{N}+(?![.,]\p{N})",
        "zerotrail": r"(?<=\p{N}\.)\p{N}*0(?![\p{N}.])",
        "degree": r"(?<=\p{N}) ?(?:°|degrees?)(?! ?[CFK]\b)",
        "percentlimit": r"(?<!\p{N})(?:0|100) ?%",
        "nospaceunit": r"(?<=\p{N})(?:px|kB|MB|GB|mm|cm|km|ms)\b",
        "writtenoutspace": r"\b(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety) (?:one|two|three|four|five|six|seven|eight|nine)\b",
    },
    "grammar": {
        "adsuffix": r"\b\p{L}{2,}?(ly|y) \p{L}{2,}?\1\b",
        "comparethen": r"\b(?:more \p{L}+|less|\p{L}{3,}er) then\b",
    },
    "start-case": {"punclower": r"(?<=[\p{Ll}]{2}[.!?] )\p{Ll}", "upperbracket": r"(?<=\p{Ll} \()\p{Lu}(?=\p{Ll})"},
}


#: A piece of a pattern: an escape, a class, a look to the side, another bracket, or one character.
_PIECE = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\\\]])*\]|\(\?<?[=!]|\((?:\?:)?|.", re.S)
#: What has another meaning, or none, in Arrow's engine.
_OTHER = re.compile(r"\\[^pPxbBntr\d\W]|&&|\(\?(?!<?[=!]|:)|\[[^\]\\]*\[")


def _guard(pattern: str) -> str | None:
    """A pattern for Arrow's linear engine that every text with a match of this one has too; none if it can't be told.

    What must stand beside a match becomes a part of it; what must not stand there, and word limits, are left out; a
    backreference becomes its group once more.
    """
    if _OTHER.search(pattern):
        return None
    out: list[str] = []
    open_now: list[tuple[str, int]] = []
    groups: dict[int, str] = {}
    n = 0
    for piece in _PIECE.findall(pattern):
        if piece[0] == "(":
            n += piece == "("
            open_now.append((piece if piece != "(" else str(n), len(out)))
            out.append("(?:")
        elif piece == ")":
            kind, k = open_now.pop()
            out.append(")")
            if kind.endswith("!"):
                del out[k:]
            elif kind.isdigit():
                groups[int(kind)] = "".join(out[k:])
        elif piece[0] == "\\" and piece[1].isdigit():
            out.append(groups[int(piece[1])])
        elif piece not in ("$", "\\b", "\\B"):
            out.append(piece)
    try:
        pc.match_substring_regex(pa.array([""]), "".join(out))
    except pa.ArrowInvalid:
        return None
    return "".join(out)


def lookaround_rules(docs: DataFrame, rules: dict[str, dict[str, str]] = LOOKAROUND) -> DataFrame:
    """``doc_id, tool, rule, n``: how often each rule matches a text, for those that do; all rules in one pass.

    The JVM's engine only counts the rules of which a text has what their guard asks for.
    """
    flat = [(t, k, p) for t, own in rules.items() for k, p in own.items()]
    guards = [_guard(p) for _, _, p in flat]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in slices([b]):
                may = [pc.match_substring_regex(texts, g) if g is not None else pa.array([True]).take(pa.array([0] * len(texts))) for g in guards]
                any_of = reduce(pc.or_, may)
                bits = pa.FixedSizeListArray.from_arrays(pa.array(np.stack([m.to_numpy(zero_copy_only=False) for m in may], axis=1).ravel()), len(guards)).cast(pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([ids.filter(any_of), texts.filter(any_of), bits.filter(any_of)], names=["doc_id", "text", "_may"])

    some = docs.where("text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, _may array<boolean>")
    count = lambda i, p: F.when(F.col("_may")[i], F.regexp_count("text", F.lit(p))).otherwise(0)
    each = F.array(*(F.struct(F.lit(t).alias("tool"), F.lit(k).alias("rule"), count(i, p).alias("n")) for i, (t, k, p) in enumerate(flat)))
    return some.select("doc_id", F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("_r")).select("doc_id", "_r.*")


def line_style(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, rule, output``: words that a line break leaves alone, judged by the first and last tokens of each line.

    ``opens_at_end``: a sentence's first word stands last in its line; ``ends_at_start``: a sentence's last word stands
    first in its line, with more after it; ``joined_at_end``: a conjunction without a comma before it, and the word after
    it, close a line; ``article_at_end``: an article does.  The last line of a text has no break after it.
    """
    lines = docs.where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("_l")).select("doc_id", F.size("_l").alias("_n"), F.posexplode("_l").alias("line_no", "_line"))
    t = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), (F.col("line_no") + 1 < F.col("_n")).alias("_broken"), (F.col("line_no") > 0).alias("_inner"), F.filter(F.split("_line", " "), lambda x: x != "").alias("_t"))
    last, before, third, first = (F.try_element_at("_t", F.lit(i)) for i in (-1, -2, -3, 1))
    word = lambda x: x.rlike(r"^[\p{L}\p{N}]+$")
    stop = lambda x: x.rlike("[.!?]$")
    rules = (
        ("opens_at_end", F.col("_broken") & stop(before) & word(last), last),
        ("ends_at_start", F.col("_inner") & (F.size("_t") > 1) & first.rlike(r"^[\p{L}\p{N}]+[.!?]$"), first),
        ("joined_at_end", F.col("_broken") & before.isin("and", "or") & word(last) & ~third.rlike(",$"), F.concat_ws(" ", before, last)),
        ("article_at_end", F.col("_broken") & (F.size("_t") > 1) & last.isin("a", "an", "the"), last),
    )
    hits = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("rule"), o.alias("output"))) for k, c, o in rules)))
    return t.select("doc_id", "line_no", F.explode(hits).alias("_h")).select("doc_id", "line_no", "_h.*")


def positions(docs: DataFrame, pattern: str) -> DataFrame:
    """``doc_id, start, output`` of every match, from the lengths of the pieces between."""
    parts = docs.where("text is not null").select("doc_id", F.split("text", pattern, -1).alias("_p"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("_m"))
    at = parts.select("doc_id", F.posexplode("_m").alias("_i", "output"), "_p", "_m")
    size = lambda c: F.aggregate(F.slice(c, F.lit(1), F.col("_i") + (1 if c == "_p" else 0)), F.lit(0), lambda a, x: a + F.length(x))
    return at.select("doc_id", (size("_p") + size("_m")).alias("start"), "output")


def abbreviations(docs: DataFrame) -> DataFrame:
    """Acronyms without an explanation before them: I if it comes later or in another document, W if there is none.

    An explanation is the acronym with words in brackets whose initials it has, or such words with the acronym in brackets.
    """
    forms = (r"\b(\p{Lu}{2,})s? \(((?:\p{L}[\p{L}\-]* ?)+)\)", 1, 2), (r"((?:\b\p{Lu}[\p{L}\-]*[ -](?:of |and |the )?){2,7})\((\p{Lu}{2,})s?\)", 2, 1)
    told = []
    for pattern, short, long in forms:
        m = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), short).alias("a"), F.regexp_extract_all("text", F.lit(pattern), long).alias("b"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("m"))
        rows = docs.where("text is not null").select("doc_id", "text", F.explode(m).alias("z"))
        initials = F.upper(F.array_join(F.transform(F.regexp_extract_all("z.b", F.lit(r"\p{L}+"), 0), lambda w: F.substring(w, 1, 1)), ""))
        told.append(rows.select("doc_id", F.col("z.a").alias("acronym"), F.instr("text", F.col("z.m")).alias("_at"), initials.alias("_i")).where(F.endswith("_i", F.col("acronym")) | F.startswith("_i", F.col("acronym"))))
    explained = told[0].unionByName(told[1]).groupBy("doc_id", "acronym").agg(F.min("_at").alias("_at"))
    uses = docs.where("text is not null").select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(\p{Lu}{2,})s?\b"), 1))).alias("acronym"))
    uses = uses.select("doc_id", "acronym", F.instr("text", F.col("acronym")).alias("start"))
    everywhere = explained.groupBy("acronym").agg(F.count("*").alias("_n"))
    j = uses.join(explained, ["doc_id", "acronym"], "left").join(everywhere, "acronym", "left")
    # The short form may follow its explanation, so only a use before the whole of it counts.
    j = j.where(F.col("_at").isNull() | (F.col("start") < F.col("_at")))
    where = F.when(F.col("_at").isNotNull(), "before its explanation").when(F.col("_n") > 0, "explained elsewhere").otherwise("without explanation")
    return j.select("doc_id", (F.col("start") - 1).alias("start"), "acronym", where.alias("message"), F.when(F.col("_n") > 0, "I").otherwise("W").alias("severity"))


def _open_ways(n: int, ends: dict[int, list[int]]) -> dict[int, list[int]]:
    """Of the parts ``start: ends`` of a word of n letters those on a way from its first letter to its last."""
    reach = {n}
    for a in range(n - 1, -1, -1):
        if any(b in reach for b in ends.get(a, ())):
            reach.add(a)
    out: dict[int, list[int]] = {}
    todo = [0] if 0 in reach else []
    while todo:
        if (a := todo.pop()) not in out and a < n:
            todo += (own := [b for b in ends[a] if b in reach])
            out[a] = own
    return out


def _splits(word: str, ends: dict[int, list[int]]) -> Iterator[str]:
    """All ways through the known parts ``start: ends`` of a word."""
    n, ends = len(word), _open_ways(len(word), ends)
    todo = [(0, "")] if ends else []
    while todo:
        a, told = todo.pop()
        if a == n:
            yield told
            continue
        todo += [(b, f"{told} {word[a:b]}" if told else word[a:b]) for b in ends[a]]


#: Up to so many lexicon words their checksums, of four bytes each, are broadcast to leave out parts that are no words.
CHECKED = 20_000_000


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _sums(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Checksums of the beginnings of words, a column for each length, and what a beginning counts for so many letters later."""
    width = max(map(len, words), default=0)
    out, letters = np.zeros((len(words), width + 1), np.uint64), np.zeros((len(words), width), np.uint64)
    size = np.array([len(w) for w in words], np.int64)
    letters[np.arange(width) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    power = np.ones(width + 1, np.uint64)
    for i in range(width):
        out[:, i + 1] = out[:, i] * _BASE + letters[:, i] + np.uint64(1)
        power[i + 1] = power[i] * _BASE
    return out, power


def _alike(words: list[str], cells: int = 200_000) -> Iterator[list[str]]:
    """Words in slices of like length, up to so many letters with what the longest is ahead of the others."""
    words = sorted(words, key=len)
    a = 0
    while a < len(words):
        b = a + 1
        while b < len(words) and b - a < 1000 and (b + 1 - a) * len(words[b]) <= cells:
            b += 1
        yield words[a:b]
        a = b


def _short(sums: np.ndarray) -> np.ndarray:
    return ((sums ^ (sums >> np.uint64(31))) * _BASE >> np.uint64(32)).astype(np.uint32)


def _checksums(words: DataFrame) -> np.ndarray:
    """Sorted checksums of the words; two words may have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in _alike(b.column(0).to_pylist()):
                yield pa.RecordBatch.from_pydict({"c": [_short(_sums(x)[0][np.arange(len(x)), [len(w) for w in x]]).tobytes()]})

    return np.unique(np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r[0], np.uint32) for r in words.mapInArrow(run, "c binary").toLocalIterator())]))


def _parts(words: DataFrame, lengths: list[int], sums) -> DataFrame:
    """``word, _a, _b, _part`` of the parts of words that may be lexicon words and lie on a way through the word; ``lengths`` are those of
    lexicon words, ``sums`` their checksums, broadcast, or none."""

    def piece(own: list[str], have: np.ndarray | None) -> pa.RecordBatch | None:
        size = np.array([len(w) for w in own])
        begun, power = _sums(own)
        ends: list[dict[int, list[int]]] = [{} for _ in own]
        for a in range(size.max()):
            for b in (a + n for n in lengths if a + n <= size.max()):
                at = np.flatnonzero((size >= b) & ((a > 0) | (size > b)))
                if have is not None:
                    told = _short(begun[at, b] - begun[at, a] * power[b - a])
                    at = at[have[np.minimum(np.searchsorted(have, told), len(have) - 1)] == told] if len(have) else at[:0]
                for i in at.tolist():
                    ends[i].setdefault(a, []).append(b)
        rows = [(w, a, b, w[a:b]) for w, x in zip(own, ends, strict=True) for a, to in _open_ways(len(w), x).items() for b in to]
        types = pa.string(), pa.int32(), pa.int32(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["word", "_a", "_b", "_part"]) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for own in _alike(whole.column(0).to_pylist()):
                if (out := piece(own, None if sums is None else sums.value)) is not None:
                    yield out

    return words.mapInArrow(run, "word string, _a int, _b int, _part string")


#: Ways that a worker gives out at once.
WAYS_OUT = 50_000


def collocations(lexicon: DataFrame, ignore: tuple[str, ...] = ("ad", "al", "de", "ed", "el", "es", "ing", "re", "un")) -> DataFrame:
    """All ways to write a lexicon word of more than four letters as other lexicon words: ``word, parts``.

    The parts of all words that may be words themselves meet the lexicon in one join; then each word by itself goes the ways
    through those that are.
    """
    plain = lexicon.where(~F.col("word").rlike(r"[-.\p{N}]") & ~F.col("word").isin(*ignore) & ((F.length("word") >= 4) | F.col("word").rlike("[aeiou]"))).select("word").distinct()
    plain = stored(plain, "lexicon")
    known = plain.withColumnRenamed("word", "_part")
    sums = lexicon.sparkSession.sparkContext.broadcast(_checksums(plain)) if plain.count() <= CHECKED else None
    parts = _parts(plain.where(F.length("word") > 4), [r[0] for r in plain.select(F.length("word")).distinct().collect()], sums)
    ways = parts.join(known, "_part", "left_semi").groupBy("word").agg(F.collect_list(F.struct("_a", "_b")).alias("_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["word", "parts"])
        for b in batches:
            rows = []
            for word, own in zip(b.column(0), b.column(1), strict=True):
                ends: dict[int, list[int]] = {}
                for x in own.as_py():
                    ends.setdefault(x["_a"], []).append(x["_b"])
                for told in _splits(w := word.as_py(), ends):
                    rows.append((w, told))
                    if len(rows) >= WAYS_OUT:
                        yield piece(rows)
                        rows = []
            if rows:
                yield piece(rows)

    return ways.mapInArrow(run, "word string, parts string")


def clauses(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Clauses of sentences, cut at a comma (not before and/or) or before and/or; ones of up to three spaces join the one before."""
    sentence = docs.select(id_col, F.posexplode(F.split("text", r"(?<=[!.?])[ \n]+", -1)).alias("sent_ix", "_s"))
    pieces = F.split("_s", r"(?<=,) (?!and |or )|(?<!,) (?=(?:and|or) )", -1)
    short = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) < 3
    # A piece joins the last one if that is still short.
    merged = F.aggregate(pieces, F.array().cast("array<string>"), lambda a, x: F.when((F.size(a) > 0) & short(F.element_at(a, -1)), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat_ws(" ", F.element_at(a, -1), x)))).otherwise(F.concat(a, F.array(x))))
    return sentence.select(id_col, "sent_ix", F.posexplode(merged).alias("clause_ix", "clause"))


def parentheses(docs: DataFrame) -> DataFrame:
    """Bracketed passages of more than three spaces."""
    p = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\(([^()]*)\)"), 1)).alias("ix", "inner"))
    return p.where(F.length("inner") - F.length(F.replace("inner", F.lit(" "), F.lit(""))) > 3)


def numbers(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])[+\-]?\p{N}+(?:[.,]\p{N}+)*(?![\p{L}\p{N}_])"), 0)).alias("ix", "number"))


def norm_word(word: Column) -> Column:
    """Hyphens and apostrophes unified, and the first letter of each hyphenated part lower, but for acronyms."""
    flat = F.translate(word, "‐‑’ʼ", "--''")
    low = lambda x: F.when(x.rlike(r"^\p{Lu}{2,}(?:s|'s|'ed)?$|^(?:\p{L}\.){2,}$"), x).otherwise(F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000)))
    return F.array_join(F.transform(F.split(flat, "-"), low), "-")


def overuse(docs: DataFrame, low: float = 2.0, high: float = 3.1, near: int = 5, far: int = 80) -> DataFrame:
    """Words that come back too soon too often: recurrences ``near < d <= far`` words apart score by closeness and word weight.

    A function word weighs 0.4, others 0.8, or 1 at the start of a sentence; a gap beyond ``far`` starts a new chain.
    """
    total = tokens.chains(docs, near, far, sorted({w for ws in v.POS.values() for w in ws}))
    rounded = F.round("score", 6)
    return total.where(rounded >= low).select("doc_id", F.col("low").alias("word"), "word_ix", rounded.alias("score"), F.when(F.col("score") < high, "I").otherwise("W").alias("severity"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.distinct_words(table(spark, sf_dir, "documents").select(F.lower("text").alias("text")))


#: Texts with brackets of few and of many words, by document.
BRACKETED = "concat(text, CASE doc_id % 3 WHEN 0 THEN ' (one two three four five) and (one two)' WHEN 1 THEN ' (a (b c d e f g) h)' ELSE '' END)"

QUERIES = {
    "lookaround_rules": lambda spark, sf: lookaround_rules(_docs(spark, sf)),
    "line_style": lambda spark, sf: line_style(_docs(spark, sf)),
    "match_positions": lambda spark, sf: positions(_docs(spark, sf), LOOKAROUND["mark"]["puncspaceend"]),
    "abbreviation": lambda spark, sf: abbreviations(_docs(spark, sf)),
    "collocation": lambda spark, sf: collocations(_lexicon(spark, sf)),
    "clauses": lambda spark, sf: clauses(_docs(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n")),
    "parentheses": lambda spark, sf: parentheses(table(spark, sf, "documents").select("doc_id", F.expr(BRACKETED).alias("text"))),
    "numbers": lambda spark, sf: numbers(_docs(spark, sf)),
    "overuse": lambda spark, sf: overuse(_docs(spark, sf)),
}
ORACLES = {
    "parentheses": r"WITH p AS (SELECT doc_id, regexp_extract_all(" + BRACKETED + r", '\\(([^()]*)\\)', 1) AS m FROM documents), e AS (SELECT doc_id, CAST(unnest(range(len(m))) AS INTEGER) AS ix, unnest(m) AS inner_text FROM p) SELECT doc_id, ix, inner_text AS inner FROM e WHERE length(inner_text) - length(replace(inner_text, ' ', '')) > 3".replace("\\\\", "\\"),
    "line_style": r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
r AS (SELECT doc_id, unnest(range(len(x))) AS line_no, len(x) AS n, unnest(x) AS line FROM l),
q AS (SELECT doc_id, line_no, n, regexp_replace(regexp_replace(line, ' +', ' ', 'g'), '^ | $', '', 'g') AS line FROM r)
SELECT doc_id, line_no, 'opens_at_end' AS rule, regexp_extract(line, '[^ ]+$') AS output FROM q WHERE line_no + 1 < n AND regexp_matches(line, '[.!?] [\p{L}\p{N}]+$')
UNION ALL SELECT doc_id, line_no, 'ends_at_start', regexp_extract(line, '^[^ ]+') FROM q WHERE line_no > 0 AND regexp_matches(line, '^[\p{L}\p{N}]+[.!?] ')
UNION ALL SELECT doc_id, line_no, 'joined_at_end', regexp_extract(line, '[^ ]+ [^ ]+$') FROM q WHERE line_no + 1 < n AND regexp_matches(line, '[^, ] (and|or) [\p{L}\p{N}]+$')
UNION ALL SELECT doc_id, line_no, 'article_at_end', regexp_extract(line, '[^ ]+$') FROM q WHERE line_no + 1 < n AND regexp_matches(line, ' (a|an|the)$')""",
    "collocation": r"""
WITH RECURSIVE w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+(?:[\x27\x{2019}\-][\p{L}\p{N}_]+)*')) AS word FROM documents),
k AS (SELECT word FROM w WHERE NOT regexp_matches(word, '[-.\p{N}]') AND word NOT IN ('ad', 'al', 'de', 'ed', 'el', 'es', 'ing', 're', 'un') AND (length(word) >= 4 OR regexp_matches(word, '[aeiou]'))),
s(word, parts, rest) AS (
  SELECT word, '', word FROM k WHERE length(word) > 4
  UNION ALL
  SELECT s.word, CASE WHEN s.parts = '' THEN k.word ELSE s.parts || ' ' || k.word END, substr(s.rest, length(k.word) + 1) FROM s JOIN k ON starts_with(s.rest, k.word) WHERE k.word <> s.word AND s.rest <> ''
)
SELECT word, parts FROM s WHERE rest = '' AND parts <> ''""",
}
