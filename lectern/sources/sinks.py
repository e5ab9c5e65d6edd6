"""Sinks of findings: sorted and rendered reports, summaries, lexicon files and edited texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.sequential import edit_documents

#: From most to least severe.
RANK = {"F": 0, "E": 1, "W": 2, "I": 3, "L": 4}
_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def write_out_quantity(n: int, subject: str) -> str:
    """A number up to 99 in words, with its subject in the plural where it is not one."""
    word = str(n) if not 0 <= n <= 99 else _SMALL[n] if n < 20 else _TENS[n // 10 - 2] + ("-" + _SMALL[n % 10] if n % 10 else "")
    return f"{word} {subject}" + ("" if n == 1 else "es" if subject.endswith(("s", "sh", "ch", "x", "z")) else "s")


def map_severity(low: float, high: float, value: Column) -> Column:
    return F.when(value < low, "L").when(value < high, "I").otherwise("W")


def _shown(column: str, most: int) -> Column:
    flat = F.replace(F.coalesce(F.col(column), F.lit("")), F.lit("\n"), F.lit("¶"))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 1)), F.lit("…"))).otherwise(flat)


def at_least(reports: DataFrame, severity: str) -> DataFrame:
    return reports.where(F.col("severity").isin(*(s for s, r in RANK.items() if r <= RANK[severity])))


def sorted_reports(reports: DataFrame, key: str = "start") -> DataFrame:
    """By path, then the key; severities in alphabetical order."""
    return reports.orderBy("path", key)


def render(reports: DataFrame) -> DataFrame:
    """One console line per finding of ``(path, start_line, start_col, severity, output, message)``; places count from 1."""
    place = F.format_string("%d,%d", F.col("start_line") + 1, F.col("start_col") + 1)
    return reports.select("path", "start_line", "start_col", F.concat_ws(" ", F.concat_ws(":", "path", place), "severity", _shown("output", 100), "message").alias("line"))


def locate(reports: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Line and column (from 0) of ``start``, and the whole line around it."""
    head = F.substring("text", F.lit(1), F.col("start").cast("int"))
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    joined = reports.join(docs.select(id_col, "text"), id_col)
    return joined.withColumns({"start_line": line, "start_col": F.length(F.substring_index(head, "\n", -1)), "line": F.try_element_at(F.split("text", "\n", -1), line + 1)}).drop("text")


def summary(reports: DataFrame) -> DataFrame:
    """Counts by severity with a total; the lowest severity is not shown, but counted in the total."""
    return reports.rollup("severity").agg(F.count("*").alias("n")).where("severity is null or severity <> 'L'").withColumn("severity", F.coalesce("severity", F.lit("total")))


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """``word, n`` as CSV with zero-based counts, most frequent first."""
    lexicon.select("word", (F.col("n") - 1).alias("n")).orderBy(F.desc("n"), "word").write.csv(path)


def write_fixed(docs: DataFrame, edits: DataFrame, path: str) -> None:
    """Edited texts as a new table; the source is never overwritten."""
    edit_documents(docs, edits).write.parquet(path)
