"""Error clusters: one row per signature, or its running state per event.

Input events are de-duplicated and carry ``signature`` (NULL unless the
severity is clustered). Order within a signature is arrival order, never time:
first_seen, sample and severity are those of the first event that arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import keys
from faultline.functions.once import with_computed
from faultline.operators.running import Running, arrival_block, with_running


def with_signature(events: DataFrame) -> DataFrame:
    """Add ``signature`` to typed events that do not come from ``ingest``."""
    signature = F.when(
        keys.is_clustered(F.col("severity")),
        keys.error_signature(
            F.col("environment"), F.col("service"), F.col("error_type"),
            F.col("stack_trace"), F.col("message"), F.col("endpoint"),
        ),
    )
    return with_computed(events, signature.alias("signature"))


def error_events(events: DataFrame) -> DataFrame:
    return events.filter(keys.is_clustered(F.col("severity")))


def clusters(events: DataFrame, by_time: bool = False) -> DataFrame:
    """``signature, count, first_seen, last_seen, sample_message, severity`` plus ISO texts.

    One aggregate with a partial step per task, so a signature with most of the
    rows costs no more than any other. ``by_time`` gives the earliest timestamp
    as first_seen instead of the first arrival's.
    """
    first = F.min_by(F.struct("ts", "ts_iso", "message", "severity"), "seq").alias("head")
    earliest = F.min(F.struct("ts", "ts_iso")).alias("earliest")
    # The first arrival among the rows with the largest time gives the text.
    latest = F.min_by(
        F.struct("ts", "ts_iso"), F.struct(-F.unix_micros("ts"), F.col("seq"))
    ).alias("latest")
    grouped = error_events(events).groupBy("signature").agg(
        F.count(F.lit(1)).alias("count"), first, latest, *([earliest] if by_time else [])
    )
    start = "earliest" if by_time else "head"
    return grouped.select(
        "signature", "count",
        F.col(f"{start}.ts").alias("first_seen"),
        F.col(f"{start}.ts_iso").alias("first_seen_iso"),
        F.col("latest.ts").alias("last_seen"),
        F.col("latest.ts_iso").alias("last_seen_iso"),
        F.col("head.message").alias("sample_message"),
        F.col("head.severity").alias("severity"),
    )


def running_clusters(events: DataFrame) -> DataFrame:
    """The cluster as it stood after each error event (read a stored table)."""
    errors = error_events(events)
    out = with_running(
        errors, ["signature"], F.col("seq"), arrival_block(errors),
        {
            "count": Running("count"),
            "head": Running("first", F.struct("ts", "ts_iso", "message", "severity")),
            "last_seen": Running("max", F.col("ts")),
        },
    )
    return out.select(
        "seq", "event_id", "signature", "count",
        F.col("head.ts").alias("first_seen"),
        F.col("head.ts_iso").alias("first_seen_iso"),
        "last_seen",
        F.col("head.message").alias("sample_message"),
        F.col("head.severity").alias("cluster_severity"),
        *[c for c in ("ts", "service", "environment", "endpoint") if c in out.columns],
    )
