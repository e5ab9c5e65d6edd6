"""K-d tree partitioning of documents into shards of near-equal bytes (operator 9).

The points of the tree are groups of equal texts: a group has the metadata of its least row and the bytes of all, so it
goes to one shard.  Only groups over ``group_share`` of a shard's bytes are dealt row by row, as they would make shards
unequal.  The tree is grown level by level over a narrow table (no texts) that holds each point's node.  A node with more
than one leaf is split at a weighted quantile (the median, if its leaves are even in number) of its widest metadata
dimension.  All splits of a level are found together by histogram refinement: one aggregation gives the bytes in each of
``buckets`` value ranges of every open node, the range that holds the quantile is refined in the next one, and ties of one
value are cut along a hash.  Histograms, splits and nodes are tables; the driver holds a row per open node at most, and
none beyond ``HELD_NODES`` leaves, so it does not bound their number.

Defined cases: a null text has size ``overhead`` and is equal to an empty one only in its bytes, so it is in its group;
null metadata counts as 0; rows that agree in identifier and text stay together (their slots differ); identifiers may be
of any type, ones that are no numbers are ordered by a hash; fewer points than shards leave shards empty; an empty table
gives an empty table; of the columns in ``keep``, those named like the ones added are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import documents, few, stored

#: Groups of equal texts up to this share of a shard's bytes are kept whole.
GROUP_SHARE = 0.02


def _rank(c: Column) -> Column:
    """A text as a number between 0 and 2^32."""
    return F.coalesce(F.conv(F.substring(F.sha1(F.coalesce(c.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double"), F.lit(0.0))


def _share(*key: str | Column) -> Column:
    return F.xxhash64(*key).cast("double") / F.lit(float(1 << 64)) + F.lit(0.5)


def _open_nodes(points: DataFrame, scale: list[float], tolerance: float) -> DataFrame:
    """A row per node that is to be split: its widest dimension, the range of it, and the bytes that go left."""
    k = len(scale)
    spread = F.array(*((F.max(F.col("x")[d]) - F.min(F.col("x")[d])) / F.lit(scale[d]) for d in range(k)))
    s = points.where("leaves > 1").groupBy("first", "leaves").agg(F.sum("w").cast("double").alias("bytes"), spread.alias("s"), F.array(*(F.min(F.col("x")[d]) for d in range(k))).alias("los"), F.array(*(F.max(F.col("x")[d]) for d in range(k))).alias("his"))
    dim = F.array_position("s", F.array_max("s")).cast("int") - 1
    s = s.withColumn("dim", dim)
    half = F.floor(F.col("leaves") / 2)
    return s.select("first", "leaves", "dim", (F.col("bytes") * half / F.col("leaves")).alias("want"), F.lit(0.0).alias("before"), F.get("los", "dim").alias("lo"), F.get("his", "dim").alias("hi"), F.lit(None).cast("double").alias("tied"), (F.lit(tolerance) * F.col("bytes") / F.col("leaves")).alias("slack"), F.lit(False).alias("done"), F.lit(0.0).alias("v"), F.lit(-1.0).alias("t"))


def _above(x: Column) -> Column:
    """A number between this one and any greater one of a table of doubles that are not next to each other."""
    return x + F.greatest(F.abs(x) * F.lit(2.0**-52), F.lit(2.0**-60))


_STATE = ("dim", "want", "before", "lo", "hi", "tied", "slack")


def _refine(points: DataFrame, state: DataFrame, buckets: int) -> DataFrame:
    """One round: the bucket of each open node that holds its quantile becomes its range, or its split."""
    inside = points.join(state.where("not done").drop("done", "v", "t"), ["first", "leaves"]).withColumn("value", F.when(F.col("tied").isNull(), F.get("x", "dim")).otherwise(F.col("tie")))
    inside = inside.where("value between lo and hi and (tied is null or get(x, dim) = tied)")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(buckets))
    b = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
    h = inside.groupBy("first", "leaves", b.alias("b")).agg(F.sum("w").cast("double").alias("own"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in _STATE))
    # At most ``buckets`` rows a node.
    node = Window.partitionBy("first", "leaves").orderBy("b")
    h = h.withColumns({"upto": F.col("before") + F.sum("own").over(node), "last": F.lead("b").over(node).isNull()}).where("upto >= want or last")
    s = h.groupBy("first", "leaves").agg(F.min_by(F.struct("own", "least", "most", "n", "upto", "last", *_STATE), "b").alias("h")).select("first", "leaves", "h.*")
    below = F.col("upto") - F.col("own")
    one = F.col("least") == F.col("most")
    # One value that several points have is cut along their hash.
    turn = one & F.col("tied").isNull() & (F.col("n") > 1)
    nearer = F.abs(F.col("upto") - F.col("want")) < F.abs(below - F.col("want"))
    close_low, close_high = F.abs(below - F.col("want")) <= F.col("slack"), F.abs(F.col("upto") - F.col("want")) <= F.col("slack")
    end = ~turn & (one | close_low | close_high | (F.col("last") & (F.col("upto") <= F.col("want"))))
    cut = F.when(F.when(one, nearer).otherwise(~close_low), _above(F.col("most"))).otherwise(F.col("least"))
    s = s.select(
        "first", "leaves", "dim", "want", below.alias("before"), F.when(turn, 0.0).otherwise(F.col("least")).alias("lo"), F.when(turn, 1.0).otherwise(F.col("most")).alias("hi"),
        F.when(turn, F.col("least")).otherwise(F.col("tied")).alias("tied"), "slack", end.alias("done"), F.coalesce("tied", cut).alias("v"), F.when(F.col("tied").isNotNull(), cut).otherwise(F.lit(-1.0)).alias("t"),
    )
    return s.unionByName(state.where("done"))


#: Up to this many open nodes their table (a row each) passes through the driver between rounds; beyond, the shared folder.
HELD_NODES = 4096


def _held(state: DataFrame, shards: int) -> tuple[DataFrame, int, bool]:
    """The table of open nodes cut from its lineage, its rows, and whether any is left to refine."""
    if shards <= HELD_NODES:
        rows = state.toArrow()
        return state.sparkSession.createDataFrame(rows, state.schema), rows.num_rows, not all(rows.column("done").to_pylist())
    state = stored(state, "nodes")
    return state, state.count(), not state.where("not done").isEmpty()


def grow(points: DataFrame, shards: int, n_dims: int, buckets: int = 512, tolerance: float = 0.002) -> DataFrame:
    """The stored ``points(unit, w, tie, x)`` with the shard of each as ``first``."""
    ends = points.agg(*(f(F.col("x")[d]) for d in range(n_dims) for f in (F.min, F.max))).first()
    scale = [(ends[2 * d + 1] - ends[2 * d]) or 1.0 for d in range(n_dims)] if ends[0] is not None else [1.0] * n_dims
    points = points.withColumns({"first": F.lit(0), "leaves": F.lit(shards)})
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        state, n, going = _held(_open_nodes(points, scale, tolerance), shards)
        while going:
            state, n, going = _held(_refine(points, few(state, n), buckets), shards)
        split = few(state.select("first", "leaves", "dim", "v", "t"), n)
        at = F.get("x", "dim")
        left = (at < F.col("v")) | ((at == F.col("v")) & (F.col("tie") < F.col("t")))
        half = F.floor(F.col("leaves") / 2).cast("int")
        # Leaves have no split and stay as they are.
        step = points.join(split, ["first", "leaves"], "left")
        points = stored(step.select("unit", "w", "tie", "x", F.when(F.col("dim").isNull() | left, F.col("first")).otherwise(F.col("first") + half).alias("first"), F.when(F.col("dim").isNull(), F.col("leaves")).when(left, half).otherwise(F.col("leaves") - half).alias("leaves")), "points")
    return points


_ADDED = ("size", "text_crc32", "shard", "slot")


def kd_shards(docs: DataFrame, shards: int | None = 24, target_bytes: int | None = None, overhead: int = 8, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", slot_rows: int = 20_000, group_share: float = GROUP_SHARE, tolerance: float = 0.002) -> DataFrame:
    """Shard and slot of every row: ``doc_id, size, text_crc32, shard, slot`` and the columns in ``keep``.

    ``shards`` fixes the number of leaves; with ``target_bytes`` instead, leaves are split until none should
    exceed it.  Slots are gapless within a shard: rows are numbered inside hash sub-buckets of about
    ``slot_rows`` rows and shifted by the sizes of the sub-buckets before, so no task orders a whole shard.
    """
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    size = (F.octet_length(data) + F.lit(overhead)).cast("long")
    of = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    keep = tuple(c for c in keep if c != id_col and c not in _ADDED)
    carried = [F.col(c).alias(f"_k_{c}") for c in keep]
    # The group of a text: two hashes and its length.
    wide = docs.select(F.col(id_col).alias("_id"), size.alias("_size"), F.crc32(data).alias("_crc"), F.xxhash64(data).alias("_text"), of(source_col).alias("_source"), of(lang_col).alias("_lang"), *carried)
    number = F.coalesce(F.col("_id").cast("string").try_cast("double"), F.when(F.col("_id").isNotNull(), _rank(F.col("_id"))))
    dims = [F.log1p(F.col("_size").cast("double")), _rank(F.col("_source")), _rank(F.col("_lang")), F.coalesce(F.when(F.isnan(number), F.lit(0.0)).otherwise(number), F.lit(0.0))]
    rows = stored(wide.withColumn("_x", F.array(*dims)).drop("_source", "_lang"), "rows")
    n, total = rows.agg(F.count("*"), F.sum("_size")).first()
    if shards is None:
        shards = max(1, math.ceil((total or 0) / target_bytes))
    group = ["_text", "_crc", "_size"]
    limit = group_share * (total or 0) / shards
    big = stored(rows.groupBy(*group).agg(F.count("*").alias("_c")).where((F.col("_c") > 1) & (F.col("_c") * F.col("_size") > F.lit(limit))).drop("_c").withColumn("_big", F.lit(True)), "large-groups")
    # There are fewer than shards / group_share of them, each with its share of all bytes.
    named = rows.join(few(big, big.count()), group, "left").withColumn("_unit", F.when(F.col("_big"), F.xxhash64(*group, F.col("_id").cast("string"))).otherwise(F.xxhash64(*group))).drop("_big")
    points = named.groupBy(F.col("_unit").alias("unit")).agg(F.sum("_size").alias("w"), F.min_by("_x", F.struct("_id", "_x")).alias("x")).withColumn("tie", _share("unit"))
    placed = grow(stored(points.select("unit", "w", "tie", "x"), "points"), shards, len(dims), tolerance=tolerance).select(F.col("unit").alias("_unit"), F.col("first").alias("shard"))
    found = stored(named.drop("_x", "_text").join(placed, "_unit").withColumn("_sub", F.pmod(F.xxhash64(F.col("_id").cast("string"), "_unit"), F.lit(max(1, math.ceil(n / max(1, shards) / slot_rows))))), "placed")
    counts = found.groupBy("shard", "_sub").agg(F.count("*").alias("_c"))
    before = counts.select("shard", "_sub", (F.sum("_c").over(Window.partitionBy("shard").orderBy("_sub")) - F.col("_c")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_sub").orderBy("_id", "_unit"))
    out = found.select("*", within.alias("_rn")).join(before, ["shard", "_sub"])
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.col("_before") + F.col("_rn") - 1).cast("long").alias("slot"), *(F.col(f"_k_{c}").alias(c) for c in keep))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shards(documents(spark, sf_dir), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
