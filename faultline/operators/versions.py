"""Versions of incidents: what was known of each at any time.

A package is a snapshot, and every further event of an incident's signature makes a new one of the same
``incident_id``. The history holds one small row per version; texts and fields that do not change stay with the incident.
Its clock is that of the evidence: a version holds from the latest time seen with it until the next version's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import keys
from faultline.operators.clusters import error_events
from faultline.operators.incidents import triggers
from faultline.operators.running import Running, arrival_block, with_running
from faultline.session import stored


def history(events: DataFrame) -> DataFrame:
    """``incident_id, version, valid_from, valid_to, event_id, count, last_seen, last_seen_iso`` of every version.

    Version 1 is the incident as it came up; the last one has no ``valid_to``. A version that the next one follows at the
    same time was never the latest of a moment, and has an empty span. Running values are taken in blocks, and
    a version finds the next by its number, so a signature with most events is not one task.
    """
    errors = error_events(events)
    state = with_running(errors, ["signature"], F.col("seq"), arrival_block(errors), {
        "count": Running("count"), "head": Running("first", F.struct("ts_iso", "severity")),
        "latest": Running("max", F.struct("ts", "ts_iso")),
    })
    threshold = keys.incident_threshold(F.col("head.severity"))
    versions = stored(state.filter(F.col("count") >= threshold).select(
        keys.incident_id(F.col("signature"), F.col("head.ts_iso")).alias("incident_id"),
        (F.col("count") - threshold + 1).cast("bigint").alias("version"), F.col("latest.ts").alias("valid_from"),
        "event_id", "count", F.col("latest.ts").alias("last_seen"), F.col("latest.ts_iso").alias("last_seen_iso"),
    ), "incident-versions")
    following = versions.select("incident_id", (F.col("version") - 1).alias("version"), F.col("valid_from").alias("valid_to"))
    return versions.join(following, ["incident_id", "version"], "left").select(
        "incident_id", "version", "valid_from", "valid_to", "event_id", "count", "last_seen", "last_seen_iso")


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    """The version of each incident that holds at a time; none of incidents that came up later. A filter, no aggregate."""
    return versions.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def incidents_of(events: DataFrame, versions: DataFrame) -> DataFrame:
    """Incidents as ``versions`` (at most one of each) saw them, with the columns of ``incidents`` and ``version``."""
    seen = versions.select("incident_id", "version", F.struct("count", "last_seen", "last_seen_iso").alias("_seen"))
    found = triggers(events)
    cluster = F.col("error_cluster")
    for name in ("count", "last_seen", "last_seen_iso"):
        cluster = cluster.withField(name, F.col(f"_seen.{name}"))
    return found.join(seen, "incident_id").withColumn("error_cluster", cluster).select(*found.columns, "version")
