"""Helpers shared by the operators: shared-folder tables, small Arrow batches, checked broadcasts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where it is unset and the session is local (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file:///tmp/lectern-checkpoints"
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lectern-{what}-{uuid.uuid4().hex}"


#: For tables of few, large, compressed values: pages end by size at any row, and no codec holds a page's copies outside the heap.
LARGE_VALUES = {"compression": "uncompressed", "parquet.page.size.row.check.min": "1"}


def stored(df: DataFrame, what: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, what)
    schema = df.schema
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512, size: str | None = None) -> None:
    """Arrow batches of so many rows, and of that size (Spark's own bound is 64 MB, held off the heap and in the worker)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    if size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same work; what it has freed goes back to the system when its task ends, as workers live on beside other tasks."""

    @wraps(run)
    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return inner


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def few(df: DataFrame, rows: int, bound: int = 2_000_000) -> DataFrame:
    """A broadcast hint if the counted rows are within the bound; beyond it a plain (shuffled) side."""
    return F.broadcast(df) if rows <= bound else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
