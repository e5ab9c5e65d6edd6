"""Benchmark decontamination over a distributed positional inverted index (operator 8).

``index_documents`` stores the index in the shared folder: one row per segment of about ``bytescan.SLICE`` bytes of
documents, with the segment's terms in hash order and the posting list (word positions) of each.  The index is
partitioned by document, so all lists of a phrase lie in one row, the list of a frequent term is spread over all
segments, and nothing is shuffled.  A segment can carry the rows it was made from, as search engines store fields.

The benchmark is cut into blocks of windows, which are files in the shared folder.  One pass over the index counts how
often each benchmark term occurs in all documents; each window's terms are then put in that order, and the second pass
takes the positions of the window's rarest term as candidates and intersects the offset-adjusted lists of the others,
rarest first, by binary search.  A worker holds one block and a few segments at a time.

Proximity matches: a window counts for ``n_near`` if somewhere in the document all its terms occur within ``slop``
words of one occurrence of its rarest term (the first of them in the window, if several are equally rare), in any order.

Defined cases: null and empty texts have no words; an item with fewer words than a window is one window; an item without
words never occurs; repeated item rows count once; a null ``item_id`` is skipped; an empty benchmark leaves every
document clean; repeated document rows are each reported; other columns are passed through by ``drop_contaminated`` and
ignored by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bytescan as bs
from lectern.llm.common import LARGE_VALUES, documents, lean, scratch, small_batches, stored

#: Bytes of benchmark text in one block of windows.
BLOCK_BYTES = 4 << 20
#: Segments in one Arrow batch: a worker holds that many at a time.
SEGMENTS = 4
#: Candidate positions that are intersected at once.
CANDIDATES = 2_000_000


def _pack(x: np.ndarray) -> bytes:
    """Compressed integers, byte by significance."""
    x = x.astype(np.int32)
    return zstandard.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.int32).ravel().astype(np.int64)


@dataclass
class Segment:
    """Term hashes in order, where each one's postings begin, postings (word numbers by term), and words per document."""

    terms: np.ndarray
    cuts: np.ndarray
    at: np.ndarray
    n_words: np.ndarray

    def lists(self, vocabulary: np.ndarray) -> np.ndarray:
        """The number of each term in this segment, or -1."""
        if not len(self.terms):
            return np.full(len(vocabulary), -1)
        i = np.minimum(np.searchsorted(self.terms, vocabulary), len(self.terms) - 1)
        return np.where(self.terms[i] == vocabulary, i, -1)


def segment_of(s: bs.Slice) -> Segment:
    starts, ends, doc, data = bs.words(s, bs.ALNUM, lower=True)
    h = bs.word_hashes(data, starts, ends)
    at = np.argsort(h, kind="stable")
    h = h[at]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return Segment(h[first], np.r_[first, len(h)], at, np.bincount(doc, minlength=s.n))


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False) -> DataFrame:
    """Store the index: ``ids, n_words, terms, sizes, postings`` per segment, and ``rows`` (the documents as Arrow data) if asked for."""
    small_batches(docs.sparkSession)
    names = docs.columns if keep_rows else [id_col, text_col]
    at = names.index(text_col)
    id_at = names.index(id_col) if id_col in names else None
    ids = docs.schema[id_col].dataType.simpleString() if id_at is not None else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in bs.slices(b.column(at)):
                g = segment_of(s)
                part = b.slice(s.first, s.n)
                own = part.column(id_at).to_pylist() if id_at is not None and not keep_rows else []
                rows = None
                if keep_rows:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(pa.concat_batches([part]))
                    rows = sink.getvalue().to_pybytes()
                kind = b.schema.field(id_at).type if id_at is not None else pa.int64()
                cols = [pa.array([own], pa.list_(kind)), *(pa.array([x], pa.binary()) for x in (_pack(g.n_words), g.terms.tobytes(), _pack(np.diff(g.cuts)), _pack(np.diff(g.at, prepend=0)), rows))]
                yield pa.RecordBatch.from_arrays(cols, names=["ids", "n_words", "terms", "sizes", "postings", "rows"])

    return stored(docs.select(*names).mapInArrow(lean(run), f"ids array<{ids}>, n_words binary, terms binary, sizes binary, postings binary, rows binary"), "index", LARGE_VALUES)


def _segments(b: pa.RecordBatch) -> list[Segment]:
    out = []
    for n, t, c, p in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("n_words", "terms", "sizes", "postings")), strict=True):
        out.append(Segment(np.frombuffer(t, np.uint64), np.r_[0, np.cumsum(_unpack(c))], np.cumsum(_unpack(p)), _unpack(n)))
    return out


@dataclass
class Windows:
    """Windows of benchmark items: term numbers padded with -1, sorted term hashes, items per window, and each window's terms by rarity."""

    terms: np.ndarray
    vocabulary: np.ndarray
    item: np.ndarray
    items: list[str]
    order: np.ndarray | None = None

    def rank(self, counts: np.ndarray) -> None:
        used = self.terms >= 0
        freq = np.where(used, counts[np.where(used, self.terms, 0)] if len(counts) else 0, np.iinfo(np.int64).max)
        self.order = np.argsort(freq, axis=1, kind="stable")


def build_windows(rows: list[tuple], width: int) -> Windows:
    names = sorted({str(i) for i, _ in rows})
    number = {n: k for k, n in enumerate(names)}
    per_item = []
    for s in bs.slices(pa.array([t or "" for _, t in rows], pa.string())):
        starts, ends, doc, data = bs.words(s, bs.ALNUM, lower=True)
        h = bs.word_hashes(data, starts, ends)
        cuts = np.searchsorted(doc, np.arange(s.n + 1))
        for i in range(s.n):
            own = h[cuts[i] : cuts[i + 1]]
            k = min(width, len(own))
            per_item += [(number[str(rows[s.first + i][0])], own[a : a + k]) for a in range(len(own) - k + 1) if k]
    vocabulary = np.unique(np.concatenate([w for _, w in per_item])) if per_item else np.zeros(0, np.uint64)
    terms = np.full((len(per_item), width), -1, dtype=np.int64)
    for r, (_, w) in enumerate(per_item):
        terms[r, : len(w)] = np.searchsorted(vocabulary, w)
    return Windows(terms, vocabulary, np.array([i for i, _ in per_item], dtype=np.int64), names)


def _write(path: str, block: Windows) -> None:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(name, compression=None) as f:
        f.write(pickle.dumps(block))


def _read(path: str) -> Windows:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        return pickle.loads(f.read())


class _Blocks:
    """The blocks in turn; a single one stays in memory."""

    def __init__(self, paths: list[str]):
        self.paths, self.last = paths, ("", None)

    def __iter__(self) -> Iterator[tuple[int, Windows]]:
        for k, p in enumerate(self.paths):
            if self.last[0] != p:
                self.last = ("", None)
                self.last = (p, _read(p))
            yield k, self.last[1]


def window_blocks(index: DataFrame, benchmark: DataFrame, width: int, item_col: str, item_text: str, block_bytes: int) -> list[str]:
    """Files of windows whose terms are ordered by how often they occur in the index; one block is on the driver at a time."""
    spark = index.sparkSession
    folder = scratch(spark, "windows")
    fs, name = pafs.FileSystem.from_uri(folder)
    fs.create_dir(name, recursive=True)
    paths, rows, size = [], [], 0

    def flush() -> None:
        if rows:
            paths.append(f"{folder}/{len(paths)}")
            _write(paths[-1], build_windows(rows, width))
            rows.clear()

    for r in benchmark.select(item_col, item_text).where(F.col(item_col).isNotNull()).distinct().toLocalIterator():
        rows.append((r[0], r[1]))
        size += len((r[1] or "").encode())
        if size >= block_bytes:
            flush()
            size = 0
    flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, sums = _Blocks(paths), {}
        for b in batches:
            own = _segments(b)
            for k, w in blocks:
                if k not in sums:
                    sums[k] = np.zeros(len(w.vocabulary), np.int64)
                for g in own:
                    i = g.lists(w.vocabulary)
                    sums[k] += np.where(i >= 0, np.diff(g.cuts)[i], 0) if len(g.terms) else 0
        for k, c in sums.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int64()), pa.array(c[some], pa.int64())], names=["block", "term", "n"])

    counts = stored(index.select("n_words", "terms", "sizes", "postings").mapInArrow(lean(count), "block int, term bigint, n bigint").groupBy("block", "term").agg(F.sum("n").alias("n")), "term-counts") if paths else None
    for k, p in enumerate(paths):
        w = _read(p)
        # As many rows as the block has terms.
        got = counts.where(F.col("block") == k).select("term", "n").toArrow()
        n = np.zeros(len(w.vocabulary), np.int64)
        n[got.column("term").to_numpy()] = got.column("n").to_numpy()
        w.rank(n)
        _write(p, w)
    return paths


class _Found:
    """What the blocks found in one segment."""

    def __init__(self, g: Segment):
        n = len(g.n_words)
        self.hit = np.zeros(int(g.n_words.sum()) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in range(n)]
        self.near = np.zeros(n, np.int64)


def _lookup(g: Segment, w: Windows, slop: int, found: _Found) -> None:
    if not len(g.at) or not len(w.vocabulary):
        return
    doc = np.repeat(np.arange(len(g.n_words)), g.n_words)
    # Documents are kept apart: positions of document d are shifted by d * gap, so no window crosses a border.
    gap = w.terms.shape[1] + slop
    place = np.arange(len(doc)) + doc * gap
    span = int(place[-1]) + 2 * gap + 1
    posting = np.repeat(np.arange(len(g.terms)), np.diff(g.cuts)) * span + place[g.at] + gap
    known = g.lists(w.vocabulary)
    # Windows all of whose terms are here, rarest term first.
    live = np.arange(len(w.terms))
    for k in range(w.terms.shape[1]):
        t = w.terms[live, w.order[live, k]]
        live = live[(t < 0) | (known[t] >= 0)]
    if not len(live):
        return
    rarest = w.order[:, 0]
    anchor = known[w.terms[live, rarest[live]]]
    n = (g.cuts[anchor + 1] - g.cuts[anchor]).astype(np.int64)
    cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(n) // CANDIDATES)) + 1, len(live)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        win = np.repeat(live[a:b], n[a:b])
        idx = np.repeat(g.cuts[anchor[a:b]], n[a:b]) + np.arange(len(win)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
        mid = posting[idx] % span
        phrase, close, keep = np.ones(len(win), dtype=bool), np.full(len(win), slop > 0), np.arange(len(win))
        for k in range(1, w.terms.shape[1]):
            col = w.order[win[keep], k]
            t = w.terms[win[keep], col]
            there = t >= 0
            base = np.where(there, known[t], 0) * span + mid[keep]
            want = base + col - rarest[win[keep]]
            p = np.minimum(np.searchsorted(posting, want), len(posting) - 1)
            phrase[keep] &= (posting[p] == want) | ~there
            if slop:
                q = np.minimum(np.searchsorted(posting, base - slop), len(posting) - 1)
                close[keep] &= ((posting[q] >= base - slop) & (posting[q] <= base + slop)) | ~there
            keep = keep[phrase[keep] | close[keep]]
        full = keep[phrase[keep]]
        word = g.at[idx[full]] - rarest[win[full]]
        size = (w.terms[win[full]] >= 0).sum(axis=1)
        np.add.at(found.hit, word, 1)
        np.add.at(found.hit, word + size, -1)
        for d, i in set(zip(doc[word].tolist(), w.item[win[full]].tolist(), strict=True)):
            found.items[d].add(w.items[i])
        if slop:
            own = keep[close[keep]]
            both = np.unique(np.stack([doc[g.at[idx[own]]], win[own]]), axis=1)
            found.near += np.bincount(both[0], minlength=len(g.n_words))


def _search(b: pa.RecordBatch, blocks: _Blocks, slop: int) -> list[tuple[Segment, _Found]]:
    own = [(g, _Found(g)) for g in _segments(b)]
    for _, w in blocks:
        for g, f in own:
            _lookup(g, w, slop, f)
    return own


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: word and hit counts, the items that occur, the flag and the hit word ranges; ``n_near`` if ``slop``."""
    index = index_documents(docs, id_col, text_col)
    paths = window_blocks(index, benchmark, width, item_col, item_text, block_bytes)
    small_batches(docs.sparkSession, SEGMENTS)
    ids = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "hit_spans"]
    span_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(paths)
        for b in batches:
            for row, (g, f) in enumerate(_search(b, blocks, slop)):
                hit = np.cumsum(f.hit[:-1]) > 0
                doc = np.repeat(np.arange(len(g.n_words)), g.n_words)
                n_hit = np.bincount(doc[hit], minlength=len(g.n_words))
                first = np.cumsum(g.n_words) - g.n_words
                spans: list[list[dict]] = [[] for _ in g.n_words]
                for d in np.flatnonzero(n_hit).tolist():
                    edge = np.flatnonzero(np.diff(np.r_[0, hit[first[d] : first[d] + g.n_words[d]].astype(np.int8), 0]))
                    spans[d] = [{"a": int(x), "b": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                named = [",".join(sorted(x)) for x in f.items]
                cols = [b.column(0)[row].values, pa.array(g.n_words), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in f.items], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in named], pa.string()), pa.array(n_hit > 0), pa.array(f.near), pa.array(spans, span_type)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = index.select("ids", "n_words", "terms", "sizes", "postings").mapInArrow(lean(run), f"{id_col} {ids}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, n_near bigint, hit_spans array<struct<a:bigint,b:bigint>>")
    return out if slop else out.drop("n_near")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs; all columns unchanged, from the rows the segments carry (no join)."""
    index = index_documents(docs, "", text_col, keep_rows=True)
    paths = window_blocks(index, benchmark, width, "item_id", "text", block_bytes)
    small_batches(docs.sparkSession, SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(paths)
        for b in batches:
            held = b.column(b.schema.get_field_index("rows"))
            for row, (_, f) in enumerate(_search(b, blocks, 0)):
                part = pa.ipc.open_stream(held[row].as_buffer()).read_next_batch()
                yield part.filter(pa.array([not x for x in f.items], pa.bool_()))

    return index.select("n_words", "terms", "sizes", "postings", "rows").mapInArrow(lean(run), docs.schema)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=SLOP)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


#: Words around a window's rarest term in which the query looks for the other terms.
SLOP = 12

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS MATERIALIZED (SELECT row_number() OVER () AS bid, item_id, {_WORDS} AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
w AS MATERIALIZED (SELECT row_number() OVER () AS wid, item_id, ws[i : i + k - 1] AS win, k FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
t AS MATERIALIZED (SELECT rid, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM d),
freq AS MATERIALIZED (SELECT term, count(*) AS n FROM t GROUP BY term),
wt AS MATERIALIZED (SELECT wid, item_id, k, unnest(win) AS term, unnest(range(k)) AS off FROM w),
anchor AS MATERIALIZED (SELECT wid, arg_min(term, (coalesce(n, 0), off)) AS term, arg_min(off, (coalesce(n, 0), off)) AS off, any_value(k) AS k, any_value(item_id) AS item_id FROM wt LEFT JOIN freq USING (term) GROUP BY wid),
place AS MATERIALIZED (SELECT term, rid, pos FROM t WHERE term IN (SELECT term FROM wt)),
cand AS MATERIALIZED (SELECT a.wid, a.item_id, a.k, p.rid, p.pos AS mid, p.pos - a.off AS st FROM anchor a JOIN place p ON a.term = p.term),
phrase AS (SELECT c.wid, c.item_id, c.rid, c.st, any_value(c.k) AS k FROM cand c JOIN wt ON wt.wid = c.wid JOIN place p ON p.term = wt.term AND p.rid = c.rid AND p.pos = c.st + wt.off GROUP BY c.wid, c.item_id, c.rid, c.st HAVING count(*) = any_value(c.k)),
near AS (SELECT rid, count(DISTINCT wid) AS n_near FROM (SELECT c.wid, c.rid, c.mid FROM cand c JOIN wt ON wt.wid = c.wid JOIN place p ON p.term = wt.term AND p.rid = c.rid AND p.pos BETWEEN c.mid - {SLOP} AND c.mid + {SLOP} GROUP BY c.wid, c.rid, c.mid HAVING count(DISTINCT wt.off) = any_value(c.k)) GROUP BY rid),
hit AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(st, st + k)) AS pos FROM phrase) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM phrase) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN near USING (rid)"""
