"""Counters of a run, one row per counter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import ingest as ing


def ingest_counters(ingested: DataFrame) -> DataFrame:
    """``counter, value`` of a run.

    ``processed`` includes duplicates, which are the processed rows beyond the
    first of each id; both come out of one aggregate.
    """
    status = F.col("status")
    counted = ingested.agg(
        F.count_if(status == ing.MALFORMED).alias("malformed"),
        F.count_if(status == ing.INVALID).alias("invalid"),
        F.count_if(status.isin(ing.WRONG_TYPE, ing.UNSUPPORTED)).alias("quarantined"),
        F.count_if(status == ing.OK).alias("processed"),
        F.count_distinct(F.when(status == ing.OK, F.col("event_id"))).alias("kept"),
    )
    return counted.select(
        "malformed", "invalid", "quarantined",
        (F.col("processed") - F.col("kept")).alias("duplicate"), "processed",
    ).unpivot([], ["malformed", "invalid", "quarantined", "duplicate", "processed"], "counter", "value")


def row_counter(rows: DataFrame, name: str) -> DataFrame:
    """``counter, value`` with the number of rows, to be unioned to the above."""
    return rows.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("counter"), "value")


def run_summary(ingested: DataFrame, clusters: DataFrame, incidents: DataFrame) -> DataFrame:
    return (
        ingest_counters(ingested)
        .unionByName(row_counter(clusters, "clusters"))
        .unionByName(row_counter(incidents, "incidents"))
    )
