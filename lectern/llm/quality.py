"""Quality rules with compression bands (operator 10).

Each document is measured in one pass over its bytes: word, symbol, duplicate-line and repeated-window
counts (the base rules), then zstandard ratios of the whole text and of each fixed chunk.  A ratio below
the band of its length means repetitive text, above it incompressible text.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows are measured
alike and each gets a row; an empty table gives an empty table; further columns are passed through by
``filter_quality`` and ignored by ``quality_measures``; a null ``doc_id`` is kept as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bytescan as bs
from lectern.llm.common import documents, lean, small_batches

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Bands:
    """Limits by text length: ``(from_bytes, lowest ratio, highest ratio)``, ascending; shorter texts than the first pass.

    Measured on the texts of sf0.1 that pass the base rules, at level 3: from 0.06 under the least ratio of each length
    to 0.02 over the greatest (two texts of one repeated word after another, 0.30 at 200 bytes, aside).
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (60, 0.70, 1.17), (100, 0.65, 1.11), (150, 0.61, 0.93), (200, 0.55, 0.877), (300, 0.506, 0.765), (450, 0.424, 0.728), (700, 0.405, 0.658), (1_000, 0.382, 0.612),
        (1_500, 0.355, 0.563), (2_200, 0.346, 0.54), (3_000, 0.323, 0.526), (4_000, 0.323, 0.498), (6_000, 0.307, 0.49), (10_000, 0.288, 0.469), (20_000, 0.285, 0.448),
    )
    chunk_bytes: int = 4096
    #: Full chunks of the same texts have 0.381 to 0.484.
    chunk: tuple[float, float] = (0.321, 0.504)
    #: A text is rejected if more than this share of its bytes is in chunks outside the limits; the last, shorter chunk has the band of its own length.
    chunk_share: float = 0.25
    level: int = 3


def band_of(bands: Bands, size: int) -> tuple[float, float] | None:
    found = None
    for least, low, high in bands.whole:
        if size >= least:
            found = (low, high)
    return found


def _measure(s: bs.Slice, bands: Bands, packer: zstandard.ZstdCompressor) -> dict[str, np.ndarray]:
    starts, ends, doc, data = bs.words(s, bs.NOT_SPACE, lower=False)
    n_words = np.bincount(doc, minlength=s.n)
    out = {
        "n_words": n_words,
        "word_chars": bs.per_doc(bs.NOT_SPACE[data] & ~bs.CONT[data], s.off),
        "n_symbols": bs.per_doc(_SYMBOL[data], s.off),
    }
    repeated = np.zeros(len(starts) + 1, dtype=np.int64)
    if len(starts) >= 5:
        at = np.flatnonzero(doc[:-4] == doc[4:])
        key = bs.window_hashes(bs.word_hashes(data, starts, ends), 5)[at] ^ bs.mix(doc[at].astype(np.uint64))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(repeated, at[twice], 1)
        np.add.at(repeated, at[twice] + 5, -1)
    out["n_repeat_words"] = np.bincount(doc, weights=np.cumsum(repeated[:-1]) > 0, minlength=s.n).astype(np.int64)
    dup, ratio, odd = np.zeros(s.n, np.int64), np.full(s.n, np.nan), np.zeros(s.n)
    good = np.ones(s.n, dtype=bool)
    for i in range(s.n):
        text = s.text(i)
        if not text:
            continue
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup[i] = len(lines) - len(set(lines))
        ratio[i] = len(packer.compress(text)) / len(text)
        full = len(text) // bands.chunk_bytes
        if full:
            parts = (text[k * bands.chunk_bytes : (k + 1) * bands.chunk_bytes] for k in range(full))
            bad = bands.chunk_bytes * sum(not bands.chunk[0] <= len(packer.compress(p)) / bands.chunk_bytes <= bands.chunk[1] for p in parts)
            tail = text[full * bands.chunk_bytes :]
            if (own := band_of(bands, len(tail))) and not own[0] <= len(packer.compress(tail)) / len(tail) <= own[1]:
                bad += len(tail)
            odd[i] = bad / len(text)
        band = band_of(bands, len(text))
        good[i] = (band is None or band[0] <= ratio[i] <= band[1]) and odd[i] <= bands.chunk_share
    failed = (n_words < 10) | (100 * out["n_repeat_words"] > 20 * n_words)
    return out | {"n_dup_lines": dup, "base_failed": failed, "kept": ~failed & good, "zstd_ratio": ratio, "odd_chunk_share": odd}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, ``kept``, and the ratios behind the verdict."""
    small_batches(docs.sparkSession)
    ids = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {ids}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean, zstd_ratio double, odd_chunk_share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for b in batches:
            for s in bs.slices(b.column(1)):
                m = _measure(s, bands, packer)
                cols = [b.column(0).slice(s.first, s.n), *(pa.array(m[c].astype(np.int64)) for c in COUNTS), pa.array(m["base_failed"]), pa.array(m["kept"]), pa.array(m["zstd_ratio"], from_pandas=True), pa.array(m["odd_chunk_share"])]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, *COUNTS, "base_failed", "kept", "zstd_ratio", "odd_chunk_share"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)


def filter_quality(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows whose text passes, all columns unchanged, in one pass without a join."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for b in batches:
            for s in bs.slices(b.column(at)):
                yield b.slice(s.first, s.n).filter(pa.array(_measure(s, bands, packer)["kept"]))

    return docs.mapInArrow(lean(run), docs.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_measures(documents(spark, sf_dir))
