"""The batch flow end to end, one stored table per stage.

    bronze -> ingested -> events -> incidents -> packages -> outbox

Each stage reads the table the one before wrote. That fixes arrival order,
parses every payload once, and lets a rerun start at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import analysis, anomalies, dedup, incidents, outbox, packages, stats
from faultline.operators.clusters import clusters
from faultline.operators.ingest import accepted, ingest, quarantine
from faultline.sources import event_store, json_documents, log_lines


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def ingest_files(spark: SparkSession, logs: str, out: str, source: str = "local") -> DataFrame:
    """Log files to the ``bronze``, ``ingested``, ``quarantine`` and ``events`` tables."""
    log_lines.write_bronze(log_lines.replay(spark, logs, source), f"{out}/bronze", mode="overwrite")
    ingested = _stored(ingest(spark.read.parquet(f"{out}/bronze")), f"{out}/ingested")
    quarantine(ingested).write.mode("overwrite").parquet(f"{out}/quarantine")
    event_store.write_events(dedup.first_arrivals(accepted(ingested)), f"{out}/events", mode="overwrite")
    return event_store.read_events(spark, f"{out}/events")


def lay_out(spark: SparkSession, out: str) -> DataFrame:
    """The ``events`` table rewritten for look-ups by id, service and time: ``events_laid_out``."""
    event_store.lay_out(event_store.read_events(spark, f"{out}/events").drop(event_store.DAY), f"{out}/events_laid_out")
    return event_store.read_events(spark, f"{out}/events_laid_out")


def detect(spark: SparkSession, out: str, as_of: str = "latest") -> DataFrame:
    """Events to the ``clusters`` and ``incidents`` tables."""
    events = event_store.read_events(spark, f"{out}/events")
    clusters(events).write.mode("overwrite").parquet(f"{out}/clusters")
    return _stored(incidents.incidents(events, as_of=as_of), f"{out}/incidents")


def hand_off(
    spark: SparkSession, out: str, analyses: DataFrame | None = None, deliveries: DataFrame | None = None,
    detector: str = "Detector", prefix: str = "incident", changes: DataFrame | None = None,
) -> DataFrame:
    """Incidents to the ``prompts``, ``packages`` and ``outbox`` tables.

    ``changes`` (change_id, service, ts) of the hours before an incident go into its package.
    """
    found = spark.read.parquet(f"{out}/incidents")
    analysis.prompts(found, analyses).write.mode("overwrite").parquet(f"{out}/prompts")
    built = packages.build_packages(found, analyses, detector)
    if changes is not None:
        spans = found.select("incident_id", "service", F.col("error_cluster.first_seen").alias("first_seen"))
        built = packages.with_correlations(built, anomalies.changes_before(spans, changes))
    built = _stored(built, f"{out}/packages")
    return _stored(outbox.investigate_outbox(built, deliveries, prefix), f"{out}/outbox")


def implement(
    spark: SparkSession, out: str, results: str, deliveries: DataFrame | None = None, prefix: str = "incident",
) -> DataFrame:
    """Investigation results (JSON files at ``results``) to the ``results`` and ``implement_outbox`` tables.

    Results with violations stay in ``results`` and are sent nowhere.
    """
    found = _stored(json_documents.read_results(spark, results), f"{out}/results")
    sound = found.filter(F.size("violations") == 0)
    rows = outbox.implement_outbox(spark.read.parquet(f"{out}/packages"), sound, deliveries, prefix)
    return _stored(rows, f"{out}/implement_outbox")


def summary(spark: SparkSession, out: str) -> DataFrame:
    """Counters of a finished run."""
    return stats.run_summary(
        spark.read.parquet(f"{out}/ingested"), spark.read.parquet(f"{out}/clusters"),
        spark.read.parquet(f"{out}/incidents"),
    )
