"""Session helpers: shipping the package to executors, and views over a table folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_lectern_shipped", False):
        return
    root = Path(__file__).resolve().parent
    name = Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern_pkg.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(name))
    sc._lectern_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share; a local one only where none is set (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file:///tmp/lectern-checkpoints"
    return f"{shared.rstrip('/')}/lectern-{what}-{uuid.uuid4().hex}"


def stored(df, what: str):
    """A table written to the shared folder and read back, for results that several branches of a plan need."""
    path, schema = scratch(df.sparkSession, what), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
