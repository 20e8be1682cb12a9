"""Raw log lines: JSON-lines text into a bronze table with arrival order.

Arrival order decides results (the first event of a key gives a cluster its
first_seen, sample and severity), so every raw row carries ``seq``:

    struct<batch: bigint, modified: timestamp, file: string, start: bigint, row: bigint>

``modified`` is the time the file was last written, so a rotated file comes
before the one that was begun after it, whatever their names. ``start`` is the offset of the split in its file and ``row`` grows inside the
split, so the struct orders rows as they stand in the files, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import strip_space

RAW_COLUMNS = ("seq", "payload", "source")


def arrival(batch: int | Column = 0) -> Column:
    """Arrival order of rows of a file scan (batch plans only)."""
    batch = F.lit(batch) if isinstance(batch, int) else batch
    return F.struct(
        batch.cast("bigint").alias("batch"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )


def nonblank(lines: DataFrame, column: str = "value") -> DataFrame:
    """Strip each line; lines of white space only are no records."""
    return lines.withColumn(column, strip_space(F.col(column))).filter(F.length(column) > 0)


def envelope(lines: DataFrame, source: str = "local", payload: str = "value") -> DataFrame:
    """``seq, payload, source``: what every later step reads, whatever the source."""
    return lines.select("seq", F.col(payload).alias("payload"), F.lit(source).alias("source"))


def replay(spark: SparkSession, path: str, source: str = "local") -> DataFrame:
    """Read log files to their end, one record per non-blank line."""
    lines = spark.read.text(path).withColumn("seq", arrival())
    return envelope(nonblank(lines), source)


def write_bronze(raw: DataFrame, path: str, mode: str = "append") -> None:
    """Store raw rows, so that ``seq`` is fixed once and read many times."""
    raw.select(*RAW_COLUMNS).write.mode(mode).parquet(path)
