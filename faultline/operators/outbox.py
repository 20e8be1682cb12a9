"""Hand-off as an outbox table: what to send, once, and what to do after attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.operators.gate import CONFIDENCE_FIELD, result_schema, result_violations, with_decision

INVESTIGATE = "investigate"
IMPLEMENT = "implement"


def event_type(kind: str, prefix: str) -> str:
    """Names the receiver listens to; the prefix is the installation's."""
    return f"{prefix}-{kind}" if prefix else kind


def _unsent(rows: DataFrame, deliveries: DataFrame | None) -> DataFrame:
    if deliveries is None:
        return rows
    sent = deliveries.filter(is_success(F.col("status_code"))).select("event_type", "incident_id")
    return rows.join(sent, ["event_type", "incident_id"], "left_anti")


def is_success(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def investigate_outbox(
    packages: DataFrame, deliveries: DataFrame | None = None, prefix: str = "incident"
) -> DataFrame:
    """``event_type, incident_id, payload`` of packages not delivered yet."""
    payload = F.to_json(F.struct(F.struct(*fv.PACKAGE_FIELDS).alias("incident_package")))
    rows = packages.select(
        F.lit(event_type(INVESTIGATE, prefix)).alias("event_type"), "incident_id",
        payload.alias("payload"),
    )
    return _unsent(rows, deliveries)


def implement_outbox(
    packages: DataFrame, results: DataFrame, deliveries: DataFrame | None = None,
    prefix: str = "incident", confidence_field: str = CONFIDENCE_FIELD,
) -> DataFrame:
    """The same for packages whose valid result passed the gate."""
    names = [part.split(" ", 1)[0] for part in result_schema(confidence_field).split(", ")]
    valid = results.filter(F.size(result_violations(confidence_field)) == 0)
    passed = with_decision(valid).filter("authorized").select(
        "incident_id", F.struct(*names).alias("investigation_result")
    )
    package = packages.select("incident_id", F.struct(*fv.PACKAGE_FIELDS).alias("incident_package"))
    payload = F.to_json(F.struct("incident_package", "investigation_result"))
    rows = package.join(passed, "incident_id").select(
        F.lit(event_type(IMPLEMENT, prefix)).alias("event_type"), "incident_id",
        payload.alias("payload"),
    )
    return _unsent(rows, deliveries)


def attempt_state(attempts: DataFrame) -> DataFrame:
    """What is due after the attempts made so far, one row per (event_type, incident_id).

    ``attempts``: ``event_type, incident_id, attempt, status_code, attempted_at``;
    a NULL status is a network error. Retryable failures wait 1 s, then 2 s,
    and end after the third attempt.
    """
    retryable = F.col("last.status_code").isNull() | F.col("last.status_code").isin(*fv.RETRYABLE_STATUS)
    latest = attempts.groupBy("event_type", "incident_id").agg(
        F.max(F.struct("attempt", "attempted_at", "status_code")).alias("last"),
        F.max(is_success(F.col("status_code"))).alias("delivered"),
    )
    due = ~F.col("delivered") & retryable & (F.col("last.attempt") < fv.MAX_ATTEMPTS)
    state = F.when(F.col("delivered"), "delivered").when(due, "retry_due").otherwise("final_failure")
    waits = F.array(*[F.lit(s) for s in fv.BACKOFF_SECONDS])
    pause = F.try_element_at(waits, F.col("last.attempt").cast("int"))
    next_at = F.timestamp_add("SECOND", pause, F.col("last.attempted_at"))
    return latest.select(
        "event_type", "incident_id",
        F.col("last.attempt").alias("attempts"),
        F.col("last.status_code").alias("status_code"),
        state.alias("state"),
        F.when(due, next_at).alias("next_attempt_at"),
    )


def lost_fields(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Packages whose JSON did not survive the hand-off unchanged.

    Both sides: ``incident_id, package`` (JSON text).
    """
    before = sent.select("incident_id", F.try_parse_json("package").alias("a"))
    after = received.select("incident_id", F.try_parse_json("package").alias("b"))
    same = F.to_json("a").eqNullSafe(F.to_json("b"))
    return before.join(after, "incident_id", "left").filter(~same).select("incident_id")
