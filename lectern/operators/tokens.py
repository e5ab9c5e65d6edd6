"""Rules on the words of one document, over all words of a slice of texts at once: Arrow finds the words, numpy compares them.

A row is a document; nothing is shuffled.  Words are compared as numbers of the slice's own dictionary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lectern.functions.dialect import SENTENCE_END, WORD
from lectern.operators.findings import pieces_of, slices

#: A stop with a space, or nothing, after it.
_STOP = r"[.!?]+(?:[ \t\n\x0B\f\r]|[\x{85}\x{2028}\x{2029}]?\z)"


@dataclass
class Tokens:
    """Tokens of some texts in order: the row of each, its number in the row, its word as a place in ``words``, whether it is a stop."""

    row: np.ndarray
    ix: np.ndarray
    word: np.ndarray
    stop: np.ndarray
    words: pa.Array

    def lower(self) -> tuple[np.ndarray, pa.Array]:
        """Each token's word in lower case as a place in a list of such words."""
        low = pa.array([w.lower() for w in self.words.to_pylist()], pa.string()).dictionary_encode()
        return low.indices.to_numpy()[self.word].astype(np.int64), low.dictionary


def tokens(texts: pa.Array, stops: str) -> Tokens:
    """Words and stops of texts without nulls."""
    own, inside, row, _ = pieces_of(texts, f"{WORD}|{stops}")
    told = own.take(pa.array(np.flatnonzero(inside))).dictionary_encode()
    row = row[inside]
    place = np.arange(len(row))
    first = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    word = told.indices.to_numpy().astype(np.int64)
    stop = np.array([w[0] in ".!?" for w in told.dictionary.to_pylist()], bool)[word] if len(word) else np.zeros(0, bool)
    return Tokens(row, place - np.maximum.accumulate(np.where(first, place, 0)), word, stop, told.dictionary)


def distinct_words(texts: DataFrame) -> DataFrame:
    """``word``: all words of the one column of texts, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, own in slices([pa.RecordBatch.from_arrays([b.column(0), b.column(0)], names=["id", "text"])]):
                words, inside, _, _ = pieces_of(own.drop_null(), WORD)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(np.flatnonzero(inside))).unique()], names=["word"])

    return texts.mapInArrow(run, "word string").distinct()


def _by_word(t: Tokens, keep: np.ndarray, low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the kept tokens sorted by row, word and place; where a word begins; and the steps from the place before in tokens."""
    at = np.flatnonzero(keep)
    key = t.row[at] * max(n, 1) + low[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(at) else np.zeros(0, bool)
    return at, new, np.concatenate(([0], np.diff(t.ix[at]))) if len(at) else at


def _mapped(docs: DataFrame, find: Callable[[pa.Array], tuple[np.ndarray, list[tuple[str, pa.Array]]]], schema: str) -> DataFrame:
    """Rows that ``find`` gives for slices of texts: the row of each, and its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            row, columns = find(texts)
            if len(row):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *(c for _, c in columns)], names=["doc_id", *(k for k, _ in columns)])

    return docs.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def returns(docs: DataFrame, near: int, far: int, least: int) -> DataFrame:
    """``doc_id, word, score``: words of over three letters whose returns after ``near`` to ``far`` words score over ``least`` together."""

    def find(texts: pa.Array) -> tuple:
        t = tokens(texts, SENTENCE_END)
        # Only words are counted.
        t = Tokens(t.row, t.ix - _count_before(t.stop, t.ix), t.word, t.stop, t.words)
        low, names = t.lower()
        long = pc.utf8_length(t.words).to_numpy() > 3
        at, new, gap = _by_word(t, ~t.stop & long[t.word], low, len(names))
        begin = np.flatnonzero(new)
        if not len(begin):
            return begin, []
        one = np.where(~new & (gap > near) & (gap <= far), (far - near) ** 2 - (gap - near) ** 2, 0)
        score, size = np.add.reduceat(one, begin), np.diff(np.append(begin, len(at)))
        good = (score > least) & (size > 1)
        head = at[begin[good]]
        return t.row[head], [("word", names.take(pa.array(low[head]))), ("score", pa.array(score[good].astype(np.int64)))]

    return _mapped(docs, find, "word string, score long")


def _count_before(mark: np.ndarray, ix: np.ndarray) -> np.ndarray:
    """How many tokens of the row before each one are marked."""
    total = np.cumsum(mark) - mark
    return total - total[np.arange(len(ix)) - ix]


def chains(docs: DataFrame, near: int, far: int, function_words: list[str]) -> DataFrame:
    """``doc_id, low, word_ix, score`` of each chain of a word's returns, a gap of over ``far`` tokens beginning a new one."""
    light = set(function_words)

    def find(texts: pa.Array) -> tuple:
        t = tokens(texts, _STOP)
        low, names = t.lower()
        letters = pc.match_substring_regex(t.words, r"\p{L}").to_numpy(zero_copy_only=False)
        opens = (t.ix == 0) | np.concatenate(([True], t.stop[:-1])) if len(t.ix) else t.stop
        at, new, step = _by_word(t, letters[t.word] if len(t.word) else t.stop, low, len(names))
        gap = step - 1
        begin = np.flatnonzero(new | (gap > far))
        if not len(begin):
            return begin, []
        weight = np.where(opens[at], 1.0, np.where(np.array([w in light for w in names.to_pylist()])[low[at]], 0.4, 0.8))
        share = (np.maximum(gap, near) - near) / float(far - near)
        score = np.where(~new & ((gap == 0) | ((gap > near) & (gap <= far))), weight * (1 - share * share), 0.0)
        head = at[begin]
        return t.row[head], [("low", names.take(pa.array(low[head]))), ("word_ix", pa.array(t.ix[head].astype(np.int32))), ("score", pa.array(np.add.reduceat(score, begin)))]

    return _mapped(docs, find, "low string, word_ix int, score double")


def near_stems(docs: DataFrame, stem: Callable[[str], str], reach: int) -> DataFrame:
    """``doc_id, sent_ix, word_ix, word, stem, distance`` of words whose stem came among the last ``reach`` of their sentence."""

    def find(texts: pa.Array) -> tuple:
        t = tokens(texts, SENTENCE_END)
        low, names = t.lower()
        stems = pa.array([stem(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
        code = stems.indices.to_numpy().astype(np.int64)[low]
        sent = _count_before(t.stop, t.ix)
        at = np.flatnonzero(~t.stop)
        row, sent, code = t.row[at], sent[at], code[at]
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (sent[1:] != sent[:-1]))) if len(at) else np.zeros(0, bool)
        place = np.arange(len(at))
        ix = place - np.maximum.accumulate(np.where(new, place, 0))
        distance = np.full(len(at), -1)
        for k in range(min(reach, len(at) - 1), 0, -1):
            same = np.flatnonzero((code[k:] == code[:-k]) & (ix[k:] >= k)) + k
            distance[same] = k - 1
        hit = np.flatnonzero(distance >= 0)
        int_ = lambda x: pa.array(x[hit].astype(np.int32))
        return row[hit], [("sent_ix", int_(sent)), ("word_ix", int_(ix)), ("word", t.words.take(pa.array(t.word[at[hit]]))), ("stem", stems.dictionary.take(pa.array(code[hit]))), ("distance", int_(distance))]

    return _mapped(docs, find, "sent_ix int, word_ix int, word string, stem string, distance int")
