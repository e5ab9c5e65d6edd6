"""Scans of file trees: texts, images, encodings, patches, lexicons and term lists."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _binary(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def scan_texts(spark: SparkSession, root: str, ext: str = ".rst") -> DataFrame:
    """``path, text`` of all files of a kind below a folder, lines ended by newline alone; a file that is no UTF-8 has a null text."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    pattern = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext.lstrip("."))
    return _binary(spark, root, pattern).select("path", F.regexp_replace(text, "\r\n?", "\n").alias("text"))


def encoding_faults(spark: SparkSession, root: str, ext: str = ".rst") -> DataFrame:
    """Places of bytes that are no UTF-8: ``path, start`` in code points of the repaired text."""
    raw = F.col("content").cast("string")
    bad = _binary(spark, root, f"*{ext}").where(~F.is_valid_utf8(raw)).select("path", F.make_valid_utf8(raw).alias("_t"))
    cut = bad.select("path", F.posexplode(F.split("_t", "�", -1)).alias("_i", "_p"), F.split("_t", "�", -1).alias("_all")).where(F.col("_i") < F.size("_all") - 1)
    before = F.aggregate(F.slice("_all", F.lit(1), F.col("_i") + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.col("_i")
    return cut.select("path", before.alias("start"), F.lit("E").alias("severity"))


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """``path, name, ext, size, digest`` of all files below a folder."""
    name = F.element_at(F.split("path", "/"), -1)
    parts = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return _binary(spark, root, None).select("path", parts[0].alias("name"), parts[1].alias("ext"), F.col("length").alias("size"), F.sha2("content", 512).alias("digest"))


def duplicate_images(images: DataFrame) -> DataFrame:
    """Each further file of equal content, with the first one by path."""
    first = images.groupBy("size", "digest").agg(F.min("path").alias("first"), F.count("*").alias("_n")).where("_n > 1")
    return images.join(first, ["size", "digest"]).where("path <> first").select("path", "first", F.lit("W").alias("severity"))


def image_names(images: DataFrame) -> DataFrame:
    """Names that differ only in case or kind, that use odd characters, and kinds that are none of the usual."""
    low = F.lower("name")
    same = images.groupBy(low.alias("_low")).agg(F.count("*").alias("_n")).where("_n > 1")
    clash = images.join(same, low == F.col("_low")).select("path", F.lit("W").alias("severity"), F.lit("similar filename").alias("message"))
    odd = images.where(F.col("name").rlike("[^a-z0-9_-]")).select("path", F.when(F.col("name").rlike("[A-Z]"), "I").otherwise("E").alias("severity"), F.lit("bad characters").alias("message"))
    kind = images.where(~F.lower("ext").isin(".png", ".jpg", ".jpeg", ".svg")).select("path", F.lit("E").alias("severity"), F.lit("unusual file type").alias("message"))
    return clash.unionByName(odd).unionByName(kind)


def selection(spec: str) -> tuple[str, int | None, int | None]:
    """``path:10-25`` as path and 1-based line range; either side may be missing, one number is one line."""
    m = re.match(r"^(.+?):(\d*)(-?)(\d*)$", spec)
    if not m or not (m[2] or m[4]):
        return spec, None, None
    a = int(m[2]) if m[2] else None
    return m[1], a, (int(m[4]) if m[4] else None) if m[3] else a


def select_lines(docs: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """The lines of a range of each text, and the number of the first (from 0)."""
    start = max(1, first or 1)
    lines = F.split("text", "\n", -1)
    stop = F.size(lines) if last is None else F.least(F.size(lines), F.lit(last))
    return docs.withColumn("text", F.array_join(F.slice(lines, F.lit(start), F.greatest(stop - (start - 1), F.lit(0))), "\n")).withColumn("start_line", F.lit(start - 1))


def flavour(text: str | None) -> str | None:
    """``svn`` or ``git``, by the first header of a patch."""
    m = re.search(r"^(Index: |diff --git )", text or "", re.M)
    return {"Index: ": "svn", "diff --git ": "git"}[m[1]] if m else None


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_patch(text: str | None) -> list[dict]:
    """Hunks of a unified diff: path, first new line (from 0), new text, and changed line ranges (end exclusive) of the new file.

    Line counts of a hunk's head say where it ends, so lines that look like headers inside a hunk do no harm; property
    changes and binary files have no hunks.
    """
    out: list[dict] = []
    path, hunk, olds, news, line = None, None, 0, 0, 0
    for raw in (text or "").split("\n"):
        if hunk is not None and (olds > 0 or news > 0) and raw[:1] in ("+", "-", " ", ""):
            sign, body = raw[:1] or " ", raw[1:]
            if sign != "-":
                hunk["lines"].append(body)
                news -= 1
            if sign != "+":
                olds -= 1
            if sign != " ":
                last = hunk["changes"][-1] if hunk["changes"] else None
                stop = line + (sign == "+")
                if last and last["end_line"] == line:
                    last["end_line"] = stop
                else:
                    hunk["changes"].append({"start_line": line, "end_line": stop})
            line += sign != "-"
            continue
        if raw.startswith("\\") and hunk is not None:
            hunk["no_newline"] = True
        elif m := _HUNK.match(raw):
            olds, news, line = int(m[2] or 1), int(m[4] or 1), max(0, int(m[3]) - 1)
            hunk = {"path": path, "start_line": line, "lines": [], "changes": [], "no_newline": False}
            if path not in (None, "/dev/null"):
                out.append(hunk)
        elif raw.startswith("+++ "):
            path, hunk = re.sub(r"^b/", "", raw[4:].split("\t")[0].strip()), None
        elif raw.startswith("Index: "):
            path, hunk = raw[7:].strip(), None
    return [{"path": h["path"], "start_line": h["start_line"], "text": "\n".join(h["lines"]) + ("" if h["no_newline"] else "\n"), "changes": h["changes"]} for h in out]


HUNKS = "patch string, path string, start_line int, text string, changes array<struct<start_line:int,end_line:int>>"


def hunks(patches: DataFrame) -> DataFrame:
    """Hunks of ``patches(path, text)``, one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"patch": p, **h} for p, t in b.itertuples(index=False, name=None) for h in parse_patch(t)]
            yield pd.DataFrame(rows, columns=["patch", "path", "start_line", "text", "changes"])

    return patches.select("path", "text").mapInPandas(run, HUNKS)


def scan_patches(spark: SparkSession, root: str, ext: str = ".patch") -> DataFrame:
    return hunks(scan_texts(spark, root, ext))


def in_changes(reports: DataFrame, changes: DataFrame) -> DataFrame:
    """Findings ``(path, start_line, ..)`` within changed lines ``(path, start_line, end_line)``."""
    c = changes.select(F.col("path").alias("_p"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    return reports.join(c, (F.col("path") == F.col("_p")) & (F.col("start_line") >= F.col("_a")) & (F.col("start_line") < F.col("_b")), "left_semi")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon CSV (word and zero-based count, no header) as words and their occurrences."""
    return spark.read.schema("word string, n bigint").csv(path).withColumn("n", F.col("n") + 1)


def read_json(path: str, branch: str | None = None):
    """A JSON file with ``//`` comment lines, or the part of it at ``a/b/c``."""
    data = json.loads("\n".join(x for x in Path(path).read_text("utf-8").splitlines() if not x.lstrip().startswith("//")))
    for key in (branch or "").split("/"):
        data = data[key] if key else data
    return data
