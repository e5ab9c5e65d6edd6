"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's neighbours are linked to the least of them: larger ones (large star) or the others (small star)."""
    pairs = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(least, "a")
    if small:
        linked = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    else:
        linked = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; the label is the least node of its component.

    Each round is one large and one small star, written to the shared folder; the edge list shrinks to one
    edge per node.  The least neighbour is aggregated before it is joined back, and a hub's rows in that join are split by
    adaptive execution.  Rounds grow with the logarithm of the
    longest chain.  An empty edge list gives an empty table.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        edges = stored(_star(_star(edges, small=False), small=True), "edges")
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
