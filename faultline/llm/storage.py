"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; in local mode, where it is unset, a new one is set there.

    On a cluster the setting is required: a machine's own folder would be lost with the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="faultline-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def stored(rows: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``rows`` written as Parquet to the shared folder and read back, by the session's codec or the one given.

    Lineage ends here: later steps read the result instead of computing it again, and a lost
    executor costs a re-read. The tables stay until the owner of the folder removes them.
    """
    spark = rows.sparkSession
    path = new_path(spark, name)
    rows.write.parquet(path, compression=compression)
    return spark.read.schema(rows.schema).parquet(path)
