"""Session settings the operators rely on."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that decide results, not speed: timestamps are read and
# printed in UTC, bad values must be handled by try_* functions instead of
# turning silently into NULL, and a repeated JSON key keeps its last value.
SEMANTIC_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Streaming state with TTL needs the RocksDB store. State on the processing clock
# asks for one empty batch after another, so an availableNow query would never
# end; expired state is ignored when read, so those batches are not needed.
STREAMING_SETTINGS = {
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# The default timestamp type of Parquet has no bounds, so no filter on a time would skip anything.
STORAGE_SETTINGS = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS"}

# Call sites in error messages cost a stack walk and a lookup per expression;
# the longer plans here have thousands of expressions. Static: set at submission.
PLANNING_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session and return it.

    Sizing (shuffle partitions, memory, AQE thresholds) stays with whoever
    submits the job.
    """
    for key, value in {**SEMANTIC_SETTINGS, **STREAMING_SETTINGS, **STORAGE_SETTINGS}.items():
        spark.conf.set(key, value)
    # Python tasks find this package where the driver found it (a cluster installs it)
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])
    return spark


def get_session(app_name: str = "faultline", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    for key, value in {**PLANNING_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str | None:
    """Folder for intermediate tables that all executors share: what ``spark.checkpoint.dir`` names, if anything."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else None


def stored(rows: DataFrame, name: str, **options: str) -> DataFrame:
    """``rows`` written to the shared folder and read back; ``rows`` itself where no folder is named.

    For results that several later steps read: they are computed once, lineage
    ends here, and a lost executor costs a re-read instead of a recomputation.
    The tables stay until the owner of the folder removes them. ``options`` are those of the writer.
    """
    folder = shared_folder(rows.sparkSession)
    if folder is None:
        return rows
    path = f"{folder}/{name}-{uuid.uuid4()}"
    rows.write.options(**options).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
