"""Streams over growing folders: a lexicon kept up by batches, watched paths, and windowed event counts.

Each micro-batch writes its partial result under its own number, overwriting what a failed try has left, so a restart
counts nothing twice; readers add the parts up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.dialect import SENTENCE_END, WORD
from lectern.session import scratch, table


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A file stream of a table, be it a file or a folder of files."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def words(docs: DataFrame) -> DataFrame:
    sentence = docs.select(F.explode(F.split("text", SENTENCE_END, -1)).alias("_s"))
    return sentence.select(F.explode(F.regexp_extract_all(F.lower("_s"), F.lit(WORD), 0)).alias("word")).where(F.length("word") >= 2)


def drain(source: DataFrame, partial: Callable[[DataFrame], DataFrame], out: str, mode: str = "append") -> None:
    """Run what is there through the stream; the partial result of batch k goes to ``out/parts/batch=k``."""

    def write(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{out}/parts/batch={number}")

    source.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def lexicon(spark: SparkSession, sf_dir: str, out: str | None = None) -> DataFrame:
    """Word counts of all documents seen; called again with the same ``out`` it reads only new files."""
    out = out or scratch(spark, "lexicon")
    drain(stream(spark, sf_dir, "documents"), lambda b: words(b).groupBy("word").agg(F.count("*").alias("n")), out)
    return spark.read.schema("word string, n bigint").parquet(f"{out}/parts").groupBy("word").agg(F.sum("n").alias("n"))


def event_windows(spark: SparkSession, sf_dir: str, length: str = "1 hour", lateness: str = "10 minutes", out: str | None = None) -> DataFrame:
    """Events per window and type.  Each batch writes the windows it changed; the last value of a window holds."""
    out = out or scratch(spark, "events")
    events = stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = events.withWatermark("ts", lateness).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"))
    drain(counts.select(F.col("w.start").alias("start"), "event_type", "n"), lambda b: b, out, "update")
    last = spark.read.schema("start timestamp, event_type string, n bigint, batch bigint").parquet(f"{out}/parts").groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")


def monitor(spark: SparkSession, sf_dir: str, watched: tuple[str, ...] = ("http://", "https://docs"), out: str | None = None) -> DataFrame:
    """Addresses below a watched prefix, once each however often they come; the stream forgets an address 30 days after it saw it."""
    out = out or scratch(spark, "monitor")
    seen = stream(spark, sf_dir, "pages").where(F.coalesce(F.greatest(*(F.col("url").startswith(w) for w in watched)), F.lit(False))).select("url", F.current_timestamp().alias("seen")).withWatermark("seen", "30 days").dropDuplicatesWithinWatermark(["url"]).select("url")
    drain(seen, lambda b: b, out)
    return spark.read.schema("url string").parquet(f"{out}/parts").select("url", F.lit("I").alias("severity")).distinct()


QUERIES = {"stream_lexicon": lexicon, "stream_event_windows": event_windows, "stream_monitor": monitor}
ORACLES = {
    "stream_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_monitor": "SELECT DISTINCT url, 'I' AS severity FROM pages WHERE url LIKE 'http://%' OR url LIKE 'https://docs%'",
}
