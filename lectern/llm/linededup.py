"""Line dedup by content-defined chunks of lines (operator 5), with DataFrame functions only.

Every line is hashed; a rolling hash over the last ``window`` line hashes ends a chunk where it is divisible by
``divisor``, so boundaries move with the text when lines are inserted or taken away.  Chunks of at least
``min_lines`` lines that occur again, in any document, are removed except for the first occurrence (by
document identifier, text hash and position).  As a short passage holds few whole chunks or none, every run of
``min_lines`` neighbouring non-blank lines (blank ones between them belong to it) is looked up in the same way, so a
repeated passage goes from its first line to its last.  A later run never takes lines of its own first occurrence.
Only hashes are counted globally; the bytes of chunks and runs whose hash repeats are then compared, so equal hashes
alone never remove anything.

Defined cases: a null text stays null and an empty one is one empty line; a null ``doc_id`` sorts before all
others; rows equal in identifier and text keep the same lines; a text that loses all its lines becomes
empty; an empty table gives an empty table; other columns are passed through, and only ``text`` changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import documents, few, stored


def lined(docs: DataFrame, text_col: str, window: int, divisor: int) -> DataFrame:
    """Add ``_lines`` and ``_spans``: the lines of each text, and ``at`` and ``to`` (first and last line) of its chunks in order."""
    step = docs.withColumn("_lines", F.split(F.col(text_col), "\n", -1)).withColumn("_h0", F.transform("_lines", lambda x: F.xxhash64(x)))
    zero = F.array(F.lit(0).cast("bigint"))
    names = ["_h0"]
    for k in range(1, window):
        # The hashes one line later; the surplus last element has no line.
        step = step.withColumn(f"_h{k}", F.concat(zero, F.col(f"_h{k - 1}")))
        names.append(f"_h{k}")
    ends = lambda z: F.pmod(F.xxhash64(*(z[n] for n in names)), F.lit(divisor)) == 0
    last = F.size("_lines") - 1
    inner = F.transform(F.arrays_zip(*names), lambda z, i: F.when(ends(z) & (i < last), i))
    step = step.withColumn("_stops", F.concat(F.filter(inner, lambda i: i.isNotNull()), F.array(last))).drop(*names)
    starts = F.concat(F.array(F.lit(0)), F.transform("_stops", lambda i: i + 1))
    spans = F.filter(F.arrays_zip(starts.alias("at"), F.col("_stops").alias("to")), lambda z: z["to"].isNotNull())
    return step.withColumn("_spans", spans).drop("_stops")


def chunked(docs: DataFrame, text_col: str = "text", window: int = 3, divisor: int = 4) -> DataFrame:
    """Add ``_chunks``: the chunks of each text in order, every line marked by a leading ``L``."""
    step = lined(docs, text_col, window, divisor)
    cut = F.transform("_spans", lambda z: F.concat(F.lit("L"), F.array_join(F.slice("_lines", z["at"] + 1, z["to"] - z["at"] + 1), "\nL")))
    return step.withColumn("_chunks", cut).drop("_lines", "_spans")


def _runs(min_lines: int) -> Column:
    """``at`` and ``to`` of every ``min_lines`` neighbouring non-blank lines."""
    full = F.filter(F.transform("_lines", lambda x, i: F.when(F.btrim(x, F.lit(" \t\r")) != "", i)), lambda i: i.isNotNull())
    later = F.slice(full, min_lines, F.greatest(F.size(full), F.lit(0)))
    return F.filter(F.arrays_zip(full.alias("at"), later.alias("to")), lambda z: z["to"].isNotNull())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, divisor: int = 4, min_lines: int = 2) -> DataFrame:
    """The rows with repeated lines cut out of the text, and ``n_lines``, ``n_chunks``, ``n_removed_chunks`` (that lost lines), ``n_removed_lines``."""
    cut = lined(docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")), "_t", window, divisor)
    spans = F.array_union(F.filter("_spans", lambda z: z["to"] - z["at"] + 1 >= min_lines), _runs(min_lines))
    runs = F.transform(spans, lambda z: F.struct(z["at"].alias("at"), z["to"].alias("to"), F.array_join(F.slice("_lines", z["at"] + 1, z["to"] - z["at"] + 1), "\n").alias("run")))
    rows = cut.select(F.col("_i").alias("_id"), F.xxhash64("_t").alias("_text"), F.explode(runs).alias("_r")).select("_id", "_text", F.col("_r.at").alias("_at"), F.col("_r.to").alias("_to"), F.col("_r.run").alias("_run"))
    rows = rows.withColumn("_key", F.xxhash64("_run"))
    again = stored(rows.groupBy("_key").agg(F.count("*").alias("_c")).where("_c > 1").select("_key"), "repeated")
    shared = stored(rows.join(few(again, again.count()), "_key", "left_semi"), "runs")
    first = shared.groupBy("_key", "_run").agg(F.min(F.struct("_id", "_text", "_at", "_to")).alias("_first"))
    # Joined by hash, then compared byte by byte.
    same = shared.alias("s").join(first.alias("f"), (F.col("s._key") == F.col("f._key")) & (F.col("s._run") == F.col("f._run"))).select("s._id", "s._text", "s._at", "s._to", "f._first")
    later = same.where(~F.struct("_id", "_text", "_at", "_to").eqNullSafe(F.col("_first")))
    own = F.struct("_id", "_text").eqNullSafe(F.struct("_first._id", "_first._text"))
    begin = F.when(own, F.greatest("_at", F.col("_first._to") + 1)).otherwise(F.col("_at"))
    gone = later.withColumn("_at", begin).where("_at <= _to").select("_id", "_text", F.explode(F.sequence("_at", "_to")).alias("_ix"))
    drops = stored(gone.groupBy("_id", "_text").agg(F.collect_set("_ix").alias("_drop")).withColumnRenamed("_text", "_of"), "drops")
    # Texts without a removed line meet no match; they keep their bytes as they are.  The input's columns travel in a struct.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
    # Broadcast by what it holds, not by its rows alone: a row's list is as long as the lines its text loses.
    held = drops.agg(F.sum(F.size("_drop") + 16)).first()[0] or 0
    joined = whole.join(few(drops, held, BROADCAST_CELLS), F.col("_i").eqNullSafe(F.col("_id")) & (F.xxhash64("_t") == F.col("_of")), "left").drop("_id", "_of", "_i")
    done = lined(joined, "_t", window, divisor)
    changed, there = F.col("_drop").isNotNull(), F.col("_t").isNotNull()
    chunk_of = F.flatten(F.transform("_spans", lambda z, k: F.array_repeat(k, z["to"] - z["at"] + 1)))
    count = lambda c, n: F.coalesce(F.when(c, n), F.lit(0)).cast("long")
    out = done.withColumn("_of", F.when(changed, chunk_of)).withColumns({"n_lines": count(there, F.size("_lines")), "n_chunks": count(there, F.size("_spans")), "n_removed_lines": count(changed, F.size("_drop")), "n_removed_chunks": count(changed, F.size(F.array_distinct(F.transform("_drop", lambda i: F.get("_of", i)))))})
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    kept = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    text = F.when(changed, kept).otherwise(F.col("_t")).alias(text_col)
    return out.select(*(text if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c not in ADDED), *ADDED)


#: Line numbers, and 16 more a row, that the table of removed lines may hold to be broadcast; a larger one is shuffled.
BROADCAST_CELLS = 8_000_000

#: Columns of the result; ones of these names in the input are replaced.
ADDED = ("n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
