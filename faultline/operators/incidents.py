"""Incidents: clusters that reached their threshold, each with its trigger event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions import keys
from faultline.operators.clusters import clusters, error_events, running_clusters

# Columns of the trigger event that prompts and packages read.
TRIGGER_COLUMNS = (
    "event_id", "ts", "ts_iso", "message", "error_type", "error_message", "stack_trace",
    "request_id", "trace_id", "version", "raw_ref", "http_status", "metadata",
)


def triggers(events: DataFrame) -> DataFrame:
    """The threshold-th event of each signature, with the cluster as of that event.

    Only the first two arrivals of a signature can be it. The rank filter turns
    into WindowGroupLimit on both sides of the shuffle, so a task sends at most
    two rows per signature.
    """
    arrival = Window.partitionBy("signature").orderBy("seq")
    upto = arrival.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    largest = max(fv.ERROR_THRESHOLD, fv.CRITICAL_THRESHOLD)
    # The rank filter comes first, so that the other windows see two rows at most.
    leading = (
        error_events(events)
        .withColumn("rank", F.row_number().over(arrival))
        .filter(F.col("rank") <= largest)
    )
    ranked = leading.withColumn(
        "head", F.first(F.struct("ts", "ts_iso", "message", "severity")).over(upto)
    ).withColumn("last_ts", F.max("ts").over(upto))
    at = ranked.filter(F.col("rank") == keys.incident_threshold(F.col("head.severity")))
    carried = [c for c in TRIGGER_COLUMNS if c in events.columns]
    # With at most two rows, the larger time is the trigger's own or the head's.
    last_iso = F.when(F.col("last_ts") == F.col("head.ts"), F.col("head.ts_iso")).otherwise(
        F.col("ts_iso")
    )
    return at.select(
        keys.incident_id(F.col("signature"), F.col("head.ts_iso")).alias("incident_id"),
        "signature",
        F.col("ts").alias("detected_at"),
        "service", "environment",
        F.col("endpoint").alias("affected_component"),
        keys.business_severity(F.col("head.severity")).alias("severity"),
        F.struct(
            F.col("signature"),
            F.col("rank").cast("bigint").alias("count"),
            F.col("head.ts").alias("first_seen"),
            F.col("head.ts_iso").alias("first_seen_iso"),
            F.col("last_ts").alias("last_seen"),
            last_iso.alias("last_seen_iso"),
            F.col("head.message").alias("sample_message"),
            F.col("head.severity").alias("severity"),
        ).alias("error_cluster"),
        F.struct(*carried).alias("trigger"),
    )


def incidents(events: DataFrame, as_of: str = "latest", live: bool = False) -> DataFrame:
    """One incident per signature that reached its threshold.

    ``as_of='trigger'`` leaves the cluster as it was when the incident came up;
    ``'latest'`` refreshes it with all events. Both sides of that join are
    partitioned by signature already. ``live`` stamps detected_at with the wall
    clock; the default is the trigger's time, so that a replay repeats.
    """
    found = triggers(events)
    if live:
        found = found.withColumn("detected_at", F.current_timestamp())
    if as_of == "trigger":
        return found
    if as_of != "latest":
        raise ValueError(f"as_of must be 'latest' or 'trigger', not {as_of!r}")
    current = clusters(events).select(
        "signature",
        F.struct(
            "signature", "count", "first_seen", "first_seen_iso", "last_seen", "last_seen_iso",
            "sample_message", "severity",
        ).alias("now"),
    )
    joined = found.join(current, "signature")
    return joined.withColumn("error_cluster", F.col("now")).drop("now").select(*found.columns)


def incident_updates(events: DataFrame) -> DataFrame:
    """Every event at or past the threshold: new once per signature, then updates."""
    state = running_clusters(events)
    threshold = keys.incident_threshold(F.col("cluster_severity"))
    return state.filter(F.col("count") >= threshold).select(
        "seq", "event_id",
        keys.incident_id(F.col("signature"), F.col("first_seen_iso")).alias("incident_id"),
        "signature", "count", "first_seen", "last_seen",
        keys.business_severity(F.col("cluster_severity")).alias("severity"),
        (F.col("count") == threshold).alias("is_new"),
    )


def upsert(known: DataFrame, found: DataFrame) -> DataFrame:
    """Incident table after a batch: known ids keep everything but their cluster."""
    fresh = found.select("signature", F.col("error_cluster").alias("_cluster"))
    refreshed = (
        known.join(fresh, "signature", "left")
        .withColumn("error_cluster", F.coalesce("_cluster", "error_cluster"))
        .drop("_cluster")
        .select(*known.columns)
    )
    new = found.join(known.select("signature"), "signature", "left_anti").select(*known.columns)
    return refreshed.unionByName(new)
