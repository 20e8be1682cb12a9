"""Session settings that the Python tasks of this package need."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


#: Bytes of a batch handed to Python; a single longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Small batches for Python tasks, UTC, and this package on the tasks' import path (local mode)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # batches handed to Python stay small, whatever the length of the texts
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{_ROOT}:{paths}".rstrip(":")
    return spark
