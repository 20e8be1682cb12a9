"""Incident lifecycle: current state, illegal steps, retries, review routes, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions.text import top_frame
from faultline.operators.running import Running, arrival_block, with_running


def current_states(transitions: DataFrame) -> DataFrame:
    """``incident_id, state, steps``: the last state of each history."""
    return transitions.groupBy("incident_id").agg(
        F.max_by("state", "seq").alias("state"), F.count(F.lit(1)).alias("steps")
    )


def allowed_steps(spark: SparkSession) -> DataFrame:
    """The fixed table of allowed steps (some fifteen rows)."""
    return spark.createDataFrame(list(fv.LIFECYCLE_STEPS), "previous string, state string")


def checked_steps(transitions: DataFrame) -> DataFrame:
    """Each transition with the state before it and whether the step is allowed.

    A history starts with DETECTED, and FAILED may follow any state.
    """
    traced = with_running(
        transitions, ["incident_id"], F.col("seq"), arrival_block(transitions),
        {"previous": Running("previous", F.col("state"))},
    )
    table = allowed_steps(transitions.sparkSession).withColumn("listed", F.lit(True))
    judged = traced.join(F.broadcast(table), ["previous", "state"], "left")
    legal = (
        (F.col("previous").isNull() & (F.col("state") == fv.INITIAL_STATE))
        | (F.col("previous").isNotNull() & (F.col("state") == fv.FAILED_STATE))
        | F.col("listed").isNotNull()
    )
    return judged.select("seq", "incident_id", "previous", "state", legal.alias("is_legal"))


def remediation_routes(transitions: DataFrame, cap: int = fv.MAX_REMEDIATIONS) -> DataFrame:
    """Each request for changes with the attempts before it: retry, or a human."""
    counted = with_running(
        transitions, ["incident_id"], F.col("seq"), arrival_block(transitions),
        {
            "attempts": Running(
                "sum", F.when(F.col("state") == "CHANGES_REQUESTED", 1).otherwise(0), before=True
            )
        },
    )
    attempts = F.coalesce("attempts", F.lit(0)).cast("bigint")
    return counted.filter(F.col("state") == "CHANGES_REQUESTED").select(
        "seq", "incident_id", attempts.alias("attempts_before"),
        F.when(attempts < cap, "RETRY").otherwise(fv.ESCALATED_STATE).alias("route"),
    )


def review_routes(findings: DataFrame, label: str) -> DataFrame:
    """Labelled items only: back to the fixer while a blocking finding is open.

    ``findings``: ``item_id, label, blocking, resolved``.
    """
    open_block = F.col("blocking") & ~F.col("resolved")
    return (
        findings.filter(F.col("label") == label)
        .groupBy("item_id")
        .agg(F.count(F.lit(1)).alias("findings"), F.count_if(open_block).alias("open_blocking"))
        .withColumn("route", F.when(F.col("open_blocking") > 0, "REMEDIATE").otherwise("HUMAN_REVIEW"))
    )


def outcomes(
    deployments: DataFrame, signatures: DataFrame, traffic: DataFrame, observe: str = "24 hours"
) -> DataFrame:
    """State of each incident after its fix was deployed.

    ``deployments``: ``incident_id, signature, service, deployed_at, touched``
    (functions the fix changed); ``signatures``: ``signature, service, frame,
    first_seen, last_seen``; ``traffic``: ``service, last_ts``.

    PERSISTING if the old signature was seen again; else REGRESSED if a new
    signature sits in a touched function, CHANGED if there is any new signature
    in the service; else RESOLVED once the service was observed for ``observe``
    after the deployment, until then IN_PROGRESS. Each question needs only the
    latest time per key, so all joins are against one-row-per-key aggregates.
    """
    new_in_service = signatures.groupBy("service").agg(
        F.max("first_seen").alias("newest"),
        F.max_by("signature", F.struct("first_seen", "signature")).alias("newest_signature"),
    )
    new_in_frame = signatures.groupBy("service", "frame").agg(
        F.max("first_seen").alias("newest_in_frame"),
        F.max_by("signature", F.struct("first_seen", "signature")).alias("frame_signature"),
    )
    touched = (
        deployments.select("incident_id", "service", "deployed_at", F.explode("touched").alias("frame"))
        .join(new_in_frame, ["service", "frame"])
        .filter(F.col("newest_in_frame") >= F.col("deployed_at"))
        .groupBy("incident_id")
        .agg(F.max_by("frame_signature", F.struct("newest_in_frame", "frame_signature")).alias("fix_signature"))
    )
    own = signatures.select("signature", F.col("last_seen").alias("own_last_seen"))
    joined = (
        deployments.join(own, "signature", "left")
        .join(new_in_service, "service", "left")
        .join(touched, "incident_id", "left")
        .join(traffic, "service", "left")
    )
    deployed = F.col("deployed_at")
    persists = F.coalesce(F.col("own_last_seen") >= deployed, F.lit(False))
    changed = F.coalesce(F.col("newest") >= deployed, F.lit(False))
    observed = F.coalesce(F.col("last_ts") >= deployed + F.expr(f"interval {observe}"), F.lit(False))
    outcome = (
        F.when(persists, "PERSISTING")
        .when(F.col("fix_signature").isNotNull(), "REGRESSED")
        .when(changed, "CHANGED")
        .when(observed, "RESOLVED")
        .otherwise("IN_PROGRESS")
    )
    symptom = (
        F.when(F.col("outcome") == "PERSISTING", F.col("signature"))
        .when(F.col("outcome") == "REGRESSED", F.col("fix_signature"))
        .when(F.col("outcome") == "CHANGED", F.col("newest_signature"))
    )
    return joined.withColumn("outcome", outcome).select(
        "incident_id", "service", "deployed_at", "outcome", symptom.alias("symptom_signature")
    )


def follow_ups(results: DataFrame) -> DataFrame:
    """Follow-up incidents of fixes that did not resolve, linked to the original."""
    open_again = results.filter(F.col("outcome").isin("PERSISTING", "CHANGED", "REGRESSED"))
    return open_again.select(
        _follow_up_id().alias("incident_id"), "service", "outcome", "symptom_signature",
        F.array("incident_id").alias("related_incident_ids"),
    )


def _follow_up_id() -> Column:
    day = F.date_format("deployed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    basis = F.concat(F.col("incident_id"), F.lit("|"), F.col("outcome"), F.lit("|"), day)
    return F.substring(F.sha2(basis, 256), 1, 16)


def signature_spans(events: DataFrame) -> DataFrame:
    """``signature, service, frame, first_seen, last_seen`` of error events."""
    head = F.min_by(F.struct("service", "stack_trace"), "seq").alias("head")
    grouped = events.filter(F.col("signature").isNotNull()).groupBy("signature").agg(
        head, F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    return grouped.select(
        "signature", F.col("head.service").alias("service"),
        top_frame(F.col("head.stack_trace")).alias("frame"), "first_seen", "last_seen",
    )


def service_traffic(events: DataFrame) -> DataFrame:
    """``service, last_ts``: how far each service was observed."""
    return events.groupBy("service").agg(F.max("ts").alias("last_ts"))
