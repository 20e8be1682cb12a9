"""Follow a folder of log files into bronze and event tables.

``follow_lines`` is for folders into which writers roll their files: Spark's
reader picks up new files, not lines appended to a file it has read.
``follow_growing`` is for files that are still written to. Offsets in the
checkpoint take the place of acknowledgements; ``StreamingQuery.stop()`` ends a follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.operators.ingest import ingest
from faultline.sources.growing_log import GrowingLog
from faultline.sources.log_lines import RAW_COLUMNS, envelope, nonblank

RAW_SCHEMA = (
    "seq struct<batch:bigint,modified:timestamp,file:string,start:bigint,row:bigint>, payload string, source string"
)


def follow_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stream of ``value, modified, file, start`` of the lines of new files, oldest files first."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select(
        "value", F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def follow_growing(
    spark: SparkSession, path: str, glob: str = "*", split_bytes: int | None = None, lose_data: bool = False
) -> DataFrame:
    """Stream of ``value, modified, file, start`` of lines as they are ended, in files of a folder or one file."""
    spark.dataSource.register(GrowingLog)
    reader = spark.readStream.format("growing_log").option("glob", glob).option("failOnDataLoss", str(not lose_data).lower())
    if split_bytes is not None:
        reader = reader.option("splitBytes", split_bytes)
    return reader.load(path).withColumn("value", F.col("value").cast("string"))


def write_bronze_stream(
    lines: DataFrame, bronze: str, checkpoint: str, source: str = "local", interval: str | None = None
) -> StreamingQuery:
    """Write each micro-batch to its own folder of ``bronze``, with arrival order.

    The row number inside a split exists in batch plans only, hence
    ``foreachBatch``; a repeated batch overwrites its own folder. Without
    ``interval`` the query ends when all present files are read.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        seq = F.struct(
            F.lit(batch_id).cast("bigint").alias("batch"), "modified", "file", "start",
            F.monotonically_increasing_id().alias("row"),
        )
        rows = envelope(nonblank(batch.withColumn("seq", seq)), source)
        rows.select(*RAW_COLUMNS).write.mode("overwrite").parquet(f"{bronze}/load={batch_id}")

    writer = lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def bronze_stream(spark: SparkSession, bronze: str) -> DataFrame:
    return spark.readStream.schema(RAW_SCHEMA).parquet(f"{bronze}/load=*")


def event_stream(raw: DataFrame, metrics: str = "ingest") -> DataFrame:
    """Ingested rows of a raw stream; counters go to the query's progress as ``metrics``."""
    rows = ingest(raw)
    status = F.col("status")
    return rows.observe(
        metrics,
        F.count_if(status == "malformed_json").alias("malformed"),
        F.count_if(status == "invalid_schema").alias("invalid"),
        F.count_if(status == "ok").alias("processed"),
    )
