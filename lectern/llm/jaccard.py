"""N-gram Jaccard self-join by a token-group matrix (operator 2).

Every document is a set of hashed word shingles; equal sets are one class.  Three exact steps follow.

1. Two filters drop the classes that cannot have a link.  A link needs an overlap of ``need(n) = ceil(0.8 n)``
   shingles, so under any common order of the shingles the first ``n - need + l`` of both sets share at least
   ``l``.  The first filter sends only those prefixes (ordered by hash) and keeps a class if enough of its
   prefix occurs in another class; the second sends the whole sets of the classes left and keeps those with
   ``need(n)`` shingles that occur elsewhere.
2. Similar classes are partitioned into groups: classes vote, by their least shared shingles, for leaders, the
   links to the leaders are verified, and connected classes form groups of bounded size.
3. The matrix holds each group's union of (rarest-first prefix) shingles.  For a class and a group of another
   component it gives an upper bound of the overlap with any member; only groups that reach the least overlap
   a link must have, and whose sizes fit, are opened and compared exactly.

Hashed blobs are dealt to buckets whose number follows the input, so no shingle, group or class is gathered
in one task beyond its bucket, links inside a component are never listed in pairs, and no cap drops a link.
Prefixes lie at the low end of the hashes, so a bucket is chosen by the mixed hash: by the plain one, the first
buckets would get several times their share.

Defined cases: null, empty and word-less texts have no shingles and are linked with nothing (their own
``doc_id`` is their component); with fewer than ``width`` words the whole sequence is one shingle; repeated rows
each get a row; a null ``doc_id`` gets the least non-null one of its component, if any; an empty table gives an empty
table; other columns are ignored.  Shingles are compared by 64-bit, sets by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bytescan as bs
from lectern.llm.common import documents, few, lean, small_batches, stored, unused
from lectern.llm.components import components

WIDTH = 5
#: A link has 100 * intersection >= 80 * union, so each side has at most a fifth outside the intersection.
NUM, DEN = 4, 5
#: Shingles that a task gathers before it sends them on to their buckets.
FLUSH = 500_000
BUCKET = 600_000
#: Prefix entries in one bucket of the first filter: each bucket repeats the digests of its sets, so more buckets take more disk.
PREFIX_BUCKET = 2_400_000
#: Entries of the matrix in one bucket: with fewer buckets a pair's share in one of them prunes more.
MATRIX_BUCKET = 2_000_000
#: Pairs of a class and a group that a bucket counts at once.
HELD = 500_000
GROUP = 64
SKETCH = 16
_WORD = pa.list_(pa.int64())
Send = Callable[[np.ndarray], np.ndarray]


def need(n: int) -> int:
    return -(-NUM * n // DEN)


def shingle_sets(s: bs.Slice, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice."""
    starts, ends, doc, data = bs.words(s, bs.NOT_SPACE, lower=True)
    h = bs.word_hashes(data, starts, ends)
    w = bs.window_hashes(h, width)
    cuts = np.searchsorted(doc, np.arange(s.n + 1))
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(w[a : b - width + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        else:
            out.append(bs.window_hashes(h[a:b], b - a) if b > a else h[:0])
    return out


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def set_table(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """``(id, hash, n, digest)`` per row: a hash of the text, the size and digest of its set; the digest is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in bs.slices(b.column(2)):
                sets = shingle_sets(s, width)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.n), b.column(1).slice(s.first, s.n), pa.array([len(x) for x in sets], pa.int64()), pa.array([digest(x) if len(x) else None for x in sets], pa.binary())], names=["id", "hash", "n", "digest"])

    return docs.select(id_col, F.xxhash64(text_col), text_col).mapInArrow(lean(run), f"id {docs.schema[id_col].dataType.simpleString()}, hash bigint, n bigint, digest binary")


_BLOB = "bucket int, tokens binary, owner binary, digests binary, sizes binary, extra binary"
_NAMES = ["bucket", "tokens", "owner", "digests", "sizes", "extra"]


def _blob_rows(bucket: np.ndarray, tokens: np.ndarray, owner: np.ndarray, digests: np.ndarray, sizes: np.ndarray, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """Pack entries by bucket: 8-byte tokens, owners as numbers into a table of digests and set sizes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    cols: list[list] = [[] for _ in _NAMES]
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)][: len(edge)], strict=True):
        own = order[a:b]
        used, local = np.unique(owner[own], return_inverse=True)
        local = local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
        row = (int(bucket[a]), tokens[own].tobytes(), local.tobytes(), digests[used].tobytes(), sizes[used].astype(np.int32).tobytes(), extra[own].astype(np.int32).tobytes() if extra is not None else None)
        for c, v in zip(cols, row, strict=True):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=_NAMES)


def _unpack(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Entries of all blobs of a bucket: tokens, owner numbers, digests (16-byte), sizes, extra."""
    tokens, owners, tables, sizes, extras, base = [], [], [], [], [], 0
    for batch in batches:
        for tok, own, dig, size, ext in zip(*(batch.column(batch.schema.get_field_index(c)) for c in _NAMES[1:]), strict=True):
            n = np.frombuffer(size.as_buffer(), np.int32)
            x = np.frombuffer(tok.as_buffer(), np.uint64)
            own = own.as_buffer()
            o = np.frombuffer(own, np.uint16 if own.size == 2 * len(x) else np.uint32).astype(np.int64)
            tokens.append(x)
            owners.append(o + base)
            tables.append(np.frombuffer(dig.as_buffer(), "V16"))
            sizes.append(n)
            if ext.is_valid:
                extras.append(np.frombuffer(ext.as_buffer(), np.int32))
            base += len(n)
    table = np.concatenate(tables)
    # Equal digests from several blobs are one owner.
    flat = table.view(np.uint64).reshape(-1, 2)
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    new = np.r_[True, (flat[order][1:] != flat[order][:-1]).any(axis=1)]
    number = np.empty(len(table), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    return np.concatenate(tokens), number[np.concatenate(owners)], table[first], np.concatenate(sizes)[first], np.concatenate(extras) if extras else None


def _bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """An even share of any range of shingle hashes for each bucket."""
    if buckets == 1:
        return np.zeros(len(tokens), np.int64)
    return (bs.mix(tokens) // np.uint64(-(-(1 << 64) // buckets))).astype(np.int64)


def _send_sets(docs: DataFrame, id_col: str, text_col: str, width: int, buckets: int, part: Send) -> DataFrame:
    """Blobs of the chosen shingles of each class, dealt to buckets by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        digests: list[bytes] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
            out = _blob_rows(_bucket_of(tokens, buckets), tokens, owner, np.frombuffer(b"".join(digests), "V16"), np.array(sizes))
            held.clear()
            digests.clear()
            sizes.clear()
            return out

        total = 0
        for b in batches:
            for s in bs.slices(b.column(0)):
                for x in shingle_sets(s, width):
                    # Sets of under four have no other set close enough.
                    if len(x) < 4 or (d := digest(x)) in seen:
                        continue
                    seen.add(d)
                    y = part(x)
                    held.append(y)
                    digests.append(d)
                    sizes.append(len(x))
                    total += len(y)
                if total > FLUSH:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return docs.select(text_col).mapInArrow(lean(run), _BLOB)


def _shared(blobs: DataFrame, digest_buckets: int) -> DataFrame:
    """Entries whose shingle is in at least two classes, with that number, dealt on by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owner, digests, sizes, _ = _unpack(batches)
        order = np.lexsort((owner, tokens))
        tokens, owner = tokens[order], owner[order]
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])]
        tokens, owner = tokens[new], owner[new]
        start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        count = np.diff(np.r_[start, len(tokens)])
        df = np.repeat(count, count)
        keep = df > 1
        tokens, owner, df = tokens[keep], owner[keep], df[keep]
        to = (digests.view(np.uint64).reshape(-1, 2)[:, 0] % np.uint64(digest_buckets)).astype(np.int64)
        yield _blob_rows(to[owner], tokens, owner, digests, sizes, df)

    return blobs.groupBy("bucket").applyInArrow(lean(run), _BLOB)


def _by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, np.ndarray, np.ndarray]]:
    tokens, owner, digests, sizes, df = _unpack(batches)
    order = np.lexsort((tokens, df, owner))
    tokens, owner, df = tokens[order], owner[order], df[order]
    cuts = np.searchsorted(owner, np.arange(len(digests) + 1))
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        yield digests[i].tobytes(), int(sizes[i]), tokens[a:b], df[a:b]


def _l1(n: int) -> int:
    return max(1, n // 20)


def _l2(n: int) -> int:
    return max(1, n // 5)


def candidates(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """Classes that can have links: ``digest, n, shared`` (sorted shingles found elsewhere), ``prefix`` (rarest first)."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = lambda n: max(1, math.ceil(n / BUCKET))
    first = _send_sets(docs, id_col, text_col, width, max(1, math.ceil(total * 0.25 / PREFIX_BUCKET)), lambda x: x[: len(x) - need(len(x)) + _l1(len(x))])

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"digest": pa.array([d for d, n, x, _ in _by_class(batches) if len(x) >= _l1(need(n))], pa.binary())})

    kept = stored(_shared(first, buckets(total * 0.05)).groupBy("bucket").applyInArrow(lean(survive), "digest binary"), "survivors")
    reps = stored(sets.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n")).join(kept, "digest").select("id", "n"), "reps")
    count, size = reps.agg(F.count("*"), F.sum("n")).first()
    ids = reps.select(F.col("id").alias(at := unused("_id", docs))).distinct()
    picked = docs.join(few(ids, count), F.col(id_col).eqNullSafe(F.col(at)), "left_semi")
    second = _send_sets(picked, id_col, text_col, width, buckets(size or 0), lambda x: x)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for d, n, x, _ in _by_class(batches):
            if len(x) >= need(n):
                prefix = x[: len(x) - need(n) + _l2(n)]
                rows.append((d, n, np.sort(x).view(np.int64), prefix.view(np.int64)))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.record_batch({"digest": pa.array(cols[0], pa.binary()), "n": pa.array(cols[1], pa.int64()), "shared": pa.array(cols[2], _WORD), "prefix": pa.array(cols[3], _WORD)})

    return stored(_shared(second, buckets(size or 0)).groupBy("bucket").applyInArrow(lean(keep), "digest binary, n bigint, shared array<bigint>, prefix array<bigint>"), "classes")


def _linked(i: Column, n: Column, m: Column) -> Column:
    return 100 * i >= 80 * (n + m - i)


def _leader_links(classes: DataFrame, labels: DataFrame, salt: int) -> DataFrame:
    """Verified links of classes to the leaders they vote for, among classes with different labels."""
    sketch = classes.select("digest", F.explode(F.slice("shared", 1, SKETCH)).alias("token")).join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    who = F.struct("digest", "label")
    # One leader for all of a family, and others that differ from shingle to shingle: in a large family, where a class is
    # linked with some members only, these connect most of it at once.
    one, each = F.xxhash64(F.lit(salt), "digest"), F.xxhash64(F.lit(salt), "token", "digest")
    leaders = sketch.groupBy("token").agg(F.count("*").alias("c"), F.min_by(who, one).alias("x"), F.min_by(who, each).alias("y"), F.max_by(who, each).alias("z")).where("c > 1").drop("c")
    votes = sketch.join(leaders, "token").select("digest", "label", F.posexplode(F.array("x", "y", "z")).alias("kind", "leader")).where("leader.label <> label").groupBy("digest", "kind", "leader.digest").agg(F.count("*").alias("votes")).toDF("digest", "kind", "leader", "votes")
    # A class has at most ``SKETCH`` leaders of a kind.
    ranked = votes.groupBy("digest", "kind").agg(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), F.xxhash64(F.lit(salt), "digest", "leader").alias("r"), "leader"))).alias("ranked"))
    best = ranked.select("digest", F.explode(F.slice("ranked", 1, 3)).alias("e")).select("digest", "e.leader")
    edges = best.select(F.greatest("digest", "leader").alias("a"), F.least("digest", "leader").alias("b")).distinct()
    side = lambda k: classes.select(F.col("digest").alias(k), F.col("n").alias(f"n_{k}"), F.col("shared").alias(f"t_{k}"))
    fit = edges.join(side("a"), "a").join(side("b"), "b").where("5 * n_a >= 4 * n_b and 5 * n_b >= 4 * n_a")
    return fit.where(_linked(F.size(F.array_intersect("t_a", "t_b")), F.col("n_a"), F.col("n_b"))).select("a", "b")


_QUERY = "digest binary, label binary, sub int, hits bigint, least bigint"


#: So far below the largest size the least need can lie; tested over all residues of the rounding (sizes repeat by 45).
LOOK_BACK = 5


def least_hits(n: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many prefix shingles a class of ``n`` must share with a linked class of between ``low`` and ``high``.

    A link's overlap is at least 4/9 of both sizes together, and the shingles after a prefix number ``need - l2``.
    The need of the linked class falls with its size but for rounding, so its least value is among the largest sizes.
    """
    ceil = lambda x, y: -(-x // y)
    after = lambda m: ceil(NUM * m, DEN) - np.maximum(1, m // 5)
    low = np.maximum(low, ceil(NUM * n, DEN))
    high = np.minimum(high, DEN * n // NUM)
    out = ceil(4 * (n + low), 9) - after(n)
    for k in range(LOOK_BACK + 1):
        m = np.maximum(low, high - k)
        out = np.minimum(out, ceil(4 * (n + m), 9) - after(m))
    return np.where(low <= high, np.maximum(out, 1), np.iinfo(np.int64).max)


_OWNERS = {"digests": pa.binary(), "labels": pa.binary(), "csize": pa.int64(), "sub": pa.int32(), "n": pa.int32(), "low": pa.int32(), "high": pa.int32(), "total": pa.int32()}


def _bucket_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of one bucket, with their hits there, that could still reach their bound.

    Owners stay in Arrow and numpy, as a bucket can hold a part of nearly every class; pairs are counted for some classes
    at a time, so what is held is bounded however many classes share a shingle.
    """
    tokens, owner, parts, base = [], [], [], 0
    for batch in batches:
        # Copies, so that each batch is freed before the next one comes.
        for tok, own, n in zip(batch.column("tokens"), batch.column("owner"), pc.list_value_length(batch.column("digests")).to_pylist(), strict=True):
            tokens.append(np.frombuffer(tok.as_buffer(), np.uint64).copy())
            owner.append(np.frombuffer(own.as_buffer(), np.int32) + np.int32(base))
            base += n
        parts.append([(x := batch.column(c).flatten()).take(pa.array(np.arange(len(x)))) for c in _OWNERS])
    tokens, owner = np.concatenate(tokens), np.concatenate(owner)
    flat = {c: pa.concat_arrays(x) for c, x in zip(_OWNERS, zip(*parts, strict=True), strict=True)}
    del parts, batch
    size, low, high, total, sub = (np.asarray(flat.pop(x)).astype(np.int64) for x in ("n", "low", "high", "total", "sub"))
    # A class's shingles in other buckets: as many hits at most can come from there.
    elsewhere = total - np.bincount(owner, minlength=len(total))
    # Components by size and label: a class asks only groups of later ones.
    labels = flat.pop("labels").dictionary_encode()
    code, names = np.asarray(labels.indices), labels.dictionary
    csize = np.zeros(len(names), np.int64)
    csize[code] = np.asarray(flat.pop("csize"))
    ranked = pc.sort_indices(pa.table({"csize": csize, "label": names}), sort_keys=[("csize", "ascending"), ("label", "ascending")])
    place = np.empty(len(names), np.int32)
    place[np.asarray(ranked)] = np.arange(len(names))
    comp, names = place[code], names.take(ranked)
    subs = int(sub.max()) + 1
    gnames, group = np.unique(comp * np.int64(subs) + sub, return_inverse=True)
    gcomp, n_groups = gnames // subs, len(gnames)
    glow, ghigh = np.zeros(n_groups, np.int64), np.zeros(n_groups, np.int64)
    glow[group], ghigh[group] = low, high
    # Only shingles of several components.
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    del order
    start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    held, c = np.diff(np.r_[start, len(tokens)]), comp[owner]
    mixed = np.minimum.reduceat(c, start) != np.maximum.reduceat(c, start)
    owner = owner[np.repeat(mixed, held)]
    token = np.repeat(np.arange(int(mixed.sum())), held[mixed])
    del tokens, c
    # The groups of each shingle in order; those an entry asks are the last ones.
    cells = np.unique(token * n_groups + group[owner])
    first = np.searchsorted(cells, token * n_groups + np.searchsorted(gcomp, comp[owner], "right"))
    count = np.searchsorted(cells, (token + 1) * n_groups) - first
    order = np.argsort(owner, kind="stable")
    order = order[count[order] > 0]
    owner, first, count = owner[order].astype(np.int64), first[order], count[order]
    del token, order
    done = np.cumsum(count)
    ends = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True]) + 1 if len(owner) else np.zeros(0, np.int64)
    a = 0
    while a < len(owner):
        # Whole classes of at most ``HELD`` pairs, or one class, whose pairs are no more than the groups.
        limit = done[a] - count[a] + HELD
        b = int(ends[max(np.searchsorted(ends, a, "right"), np.searchsorted(done[ends - 1], limit, "right") - 1)])
        k, hits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while a < b:
            e = min(b, max(a + 1, int(np.searchsorted(done, done[a] - count[a] + HELD, "right"))))
            n = count[a:e]
            cell = np.repeat(first[a:e] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            more, times = np.unique(np.repeat(owner[a:e], n) * n_groups + cells[cell] % n_groups, return_counts=True)
            if len(k):
                more, inv = np.unique(np.concatenate([k, more]), return_inverse=True)
                times = np.bincount(inv, weights=np.concatenate([hits, times])).astype(np.int64)
            k, hits, a = more, times, e
        who, to = k // n_groups, k % n_groups
        least = least_hits(size[who], glow[to], ghigh[to])
        # Left out here: sizes that no link can have, and pairs whose hits fall short even with all shingles elsewhere.
        fit = hits + elsewhere[who] >= least
        who, to = who[fit], to[fit]
        if len(who):
            yield pa.record_batch({"digest": flat["digests"].take(pa.array(who)), "label": names.take(pa.array(gcomp[to])), "sub": pa.array((gnames[to] % subs).astype(np.int32)), "hits": pa.array(hits[fit]), "least": pa.array(least[fit])})


def _matrix_bounds(grouped: DataFrame, buckets: int) -> DataFrame:
    """The classes and groups of a larger component whose common prefix shingles reach the least a link needs.

    The shingles are dealt to buckets; the hits of a pair in each bucket are summed over all of them, so the bound is the
    same whatever their number.  A pair is sent on from a bucket only if its hits there and the class's shingles in all
    other buckets could reach the bound.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            offsets = np.asarray(b.column(0).offsets)
            tokens = np.asarray(b.column(0).flatten()).view(np.uint64)
            owner = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            bucket = _bucket_of(tokens, buckets)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.unique(bucket).tolist():
                own = order[edge[k] : edge[k + 1]]
                used, local = np.unique(owner[own], return_inverse=True)
                part = b.take(pa.array(used))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([tokens[own].tobytes()], pa.binary()), pa.array([local.astype(np.int32).tobytes()], pa.binary()), *(pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), part.column(i + 1).cast(t)) for i, t in enumerate(_OWNERS.values()))], names=["bucket", "tokens", "owner", *_OWNERS])

    blob = "bucket int, tokens binary, owner binary, digests array<binary>, labels array<binary>, csize array<bigint>, sub array<int>, n array<int>, low array<int>, high array<int>, total array<int>"
    dealt = grouped.select("prefix", "digest", "label", "csize", "sub", *(F.col(x).cast("int") for x in ("n", "low", "high")), F.size("prefix").alias("total")).mapInArrow(lean(deal), blob)
    part = dealt.groupBy("bucket").applyInArrow(lean(_bucket_hits), _QUERY)
    return part.groupBy("digest", "label", "sub").agg(F.sum("hits").alias("hits"), F.max("least").alias("least")).where("hits >= least").select("digest", "label", "sub")


def _open(members: pa.Table, queries: pa.Table) -> pa.Table:
    """Exact comparison of a block of classes with the members of one group: one link per class at most."""
    found: list[tuple[bytes, bytes]] = []
    if members.num_rows and queries.num_rows:
        sets = [np.asarray(x, np.int64) for x in members.column("shared").to_numpy()]
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        sizes, names = np.asarray(members.column("n")), members.column("digest").to_pylist()
        for d, n, own in zip(queries.column("digest").to_pylist(), queries.column("n").to_pylist(), queries.column("shared").to_numpy(), strict=True):
            a, b = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            hit = np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange((b - a).sum())
            i = np.bincount(owner[hit], minlength=len(sets))
            if (ok := np.flatnonzero(100 * i >= 80 * (n + sizes - i))).size:
                found.append((d, names[int(ok[0])]))
    return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})


def class_links(classes: DataFrame, rounds: int = 2) -> DataFrame:
    """Links ``(a, b)`` between classes that connect what any link connects."""
    spark = classes.sparkSession
    labels = spark.createDataFrame([], "digest binary, label binary")
    links = spark.createDataFrame([], "a binary, b binary")
    for k in range(rounds):
        more = stored(_leader_links(classes, labels, 2 * k + 1), "links")
        links = links.unionByName(more)
        labels = stored(components(links).withColumnRenamed("node", "digest"), "labels")
    sizes = labels.groupBy("label").agg(F.count("*").alias("csize"))
    known = labels.join(sizes, "label")
    grouped = stored(classes.join(known, "digest", "left").withColumns({"label": F.coalesce("label", "digest"), "csize": F.coalesce("csize", F.lit(1).cast("bigint"))}).withColumn("sub", F.pmod(F.xxhash64("digest"), F.ceil(F.col("csize") / GROUP)).cast("int")), "grouped")
    entries = grouped.agg(F.sum(F.size("prefix"))).first()[0] or 0
    reach = grouped.groupBy("label", "sub").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    open_now = stored(_matrix_bounds(grouped.join(reach, ["label", "sub"]), max(1, math.ceil(entries / MATRIX_BUCKET))), "open")
    blocks = stored(open_now.groupBy("label", "sub").agg(F.ceil(F.count("*") / 256).cast("int").alias("blocks")), "blocks")
    queries = open_now.join(blocks, ["label", "sub"]).withColumn("block", F.pmod(F.xxhash64("digest"), "blocks").cast("int")).join(classes.select("digest", "n", "shared"), "digest").select("label", "sub", "block", "digest", "n", "shared")
    members = grouped.join(blocks, ["label", "sub"]).select("label", "sub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "digest", "n", "shared")
    keys = ["label", "sub", "block"]
    opened = members.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_open, "a binary, b binary")
    return links.unionByName(stored(opened, "links"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, hash, n, digest, label)`` of every row; rows with one label are connected by links, and without words there is none."""
    small_batches(docs.sparkSession, size="4m")
    sets = stored(set_table(docs, id_col, text_col, width), "sets")
    labels = components(class_links(candidates(docs, sets, id_col, text_col, width)))
    return sets.join(labels.select(F.col("node").alias("digest"), "label"), "digest", "left").select("id", "hash", "n", "digest", F.coalesce("label", "digest").alias("label"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``(id, n_shingles, digest, component_id)`` for every row: the least identifier reachable by links."""
    named = stored(_labelled(docs, id_col, text_col, width), "labelled")
    least = named.where("label is not null").groupBy("label").agg(F.min("id").alias("least"))
    return named.join(least, "label", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "digest", F.coalesce("least", "id").alias("component_id"))


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of each component: the least identifier's, and of its texts the one with the least hash.

    Rows without words and with a null identifier stay.  Rows are told apart by identifier and text, so unlinked texts
    under one identifier are judged each for itself.
    """
    found = stored(_labelled(docs, id_col, text_col, width).where("label is not null and id is not null"), "labelled")
    winners = found.groupBy("label").agg(F.min(F.struct("id", "hash")).alias("w")).select("w.id", "w.hash")
    rows = found.groupBy("id", "hash").agg(F.count("*").alias("c"))
    i, h = unused("_id", docs), unused("_hash", docs)
    named = lambda df: stored(df.select(F.col("id").alias(i), F.col("hash").alias(h)), "rows")
    gone, again = named(rows.join(winners, ["id", "hash"], "left_anti")), named(rows.where("c > 1").join(winners, ["id", "hash"], "left_semi"))
    same = (F.col(id_col) == F.col(i)) & (F.xxhash64(text_col) == F.col(h))
    left = docs.join(few(gone, gone.count()), same, "left_anti")
    if not (n := again.count()):
        return left
    # Repeated rows of a document that stays: only those are compared row by row.
    return left.join(few(again, n), same, "left_anti").unionByName(left.join(few(again, n), same, "left_semi").dropDuplicates([id_col, text_col]))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
