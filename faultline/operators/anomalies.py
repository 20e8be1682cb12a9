"""Abnormal patterns in events and incidents.

The requirements name the patterns but no numbers; window, baseline length and
limits are ours and are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import keys
from faultline.operators.running import Running, with_running
from faultline.session import stored


def hourly_rates(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """``service, window_start, total, errors, critical``: a partial aggregate, then tiny."""
    return (
        events.groupBy("service", F.window("ts", width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(keys.is_clustered(F.col("severity"))).alias("errors"),
            F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        )
        .select("service", F.col("w.start").alias("window_start"), "total", "errors", "critical")
    )


def judged_rates(scored: DataFrame, min_baseline: int = 3, deviations: float = 3.0, min_errors: int = 2) -> DataFrame:
    """Windows with ``rate, baseline_windows, baseline, spread``: rounded, and ``is_spike`` where the rate clearly exceeds its baseline."""
    above = F.col("rate") > F.col("baseline") + F.lit(deviations) * F.col("spread")
    return scored.select(
        "service", "window_start", "total", "errors", "baseline_windows",
        F.round("rate", 6).alias("rate"), F.round("baseline", 6).alias("baseline"),
        F.coalesce(
            above & (F.col("errors") >= min_errors) & (F.col("baseline_windows") >= min_baseline),
            F.lit(False),
        ).alias("is_spike"),
    )


def error_rate_spikes(
    events: DataFrame, width: str = "1 hour", baseline_windows: int = 24,
    min_baseline: int = 3, deviations: float = 3.0, min_errors: int = 2,
) -> DataFrame:
    """Each service window with its baseline; ``is_spike`` where it clearly exceeds it."""
    past = Window.partitionBy("service").orderBy("window_start").rowsBetween(-baseline_windows, -1)
    scored = (
        hourly_rates(events, width)
        .withColumn("rate", F.col("errors") / F.col("total"))
        .withColumn("baseline_windows", F.count("rate").over(past))
        .withColumn("baseline", F.avg("rate").over(past))
        .withColumn("spread", F.stddev_samp("rate").over(past))
    )
    return judged_rates(scored, min_baseline, deviations, min_errors)


def new_signatures(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Clusters of ``current`` whose signature ``prior`` does not hold."""
    return current.join(prior.select("signature"), "signature", "left_anti")


def judged_shares(rated: DataFrame, min_rise: float = 0.25, min_errors: int = 3) -> DataFrame:
    """Windows with ``share`` and ``previous_share``, and ``is_elevated`` where the share has risen enough."""
    rise = F.round(F.col("share") - F.col("previous_share"), 6)
    return rated.select(
        "service", "window_start", "total", "errors", "critical", "share", "previous_share",
        F.coalesce((rise >= min_rise) & (F.col("errors") >= min_errors), F.lit(False)).alias("is_elevated"),
    )


def severity_shift(
    events: DataFrame, width: str = "1 hour", min_rise: float = 0.25, min_errors: int = 3
) -> DataFrame:
    """Share of error events per service window against the window before."""
    order = Window.partitionBy("service").orderBy("window_start")
    share = F.round(F.col("errors") / F.col("total"), 6)
    rated = hourly_rates(events, width).withColumn("share", share)
    return judged_shares(rated.withColumn("previous_share", F.lag("share").over(order)), min_rise, min_errors)


def _minute(ts: str) -> Column:
    return F.date_trunc("minute", ts)


def incident_groups(incidents: DataFrame) -> DataFrame:
    """Incidents of a service whose [first_seen, last_seen] chain together.

    One row per incident with the start of its group, found by a running
    maximum of last_seen; overlapping pairs are never listed. ``incidents``:
    ``incident_id, service, first_seen, last_seen``; read more than once, so
    pass a stored table.
    """
    rows = incidents.select("incident_id", "service", "first_seen", "last_seen")
    order = F.struct("first_seen", "incident_id")
    reach = with_running(
        rows, ["service"], order, _minute("first_seen"),
        {"reached": Running("max", F.col("last_seen"), before=True)},
    )
    opens = F.col("reached").isNull() | (F.col("first_seen") > F.col("reached"))
    starts = stored(reach.withColumn("start", F.when(opens, F.col("first_seen"))).drop("reached"), "group-starts")
    grouped = with_running(
        starts, ["service"], order, _minute("first_seen"),
        {"group_start": Running("max", F.col("start"))},
    )
    return grouped.select("incident_id", "service", "first_seen", "last_seen", "group_start")


def group_sizes(grouped: DataFrame) -> DataFrame:
    """One row per group of more than one incident."""
    return (
        grouped.groupBy("service", "group_start")
        .agg(F.count(F.lit(1)).alias("incidents"), F.max("last_seen").alias("group_end"))
        .filter(F.col("incidents") > 1)
    )


def correlated_changes(incidents: DataFrame, changes: DataFrame, within: str = "6 hours") -> DataFrame:
    """Changes (deployments, alerts) near each incident of the same service, in time only.

    For the changes themselves see ``changes_before``. Counts those in ``[first_seen - within, last_seen]`` and names the nearest
    one at or before first_seen. Works on one time-ordered union of changes and
    three probes per incident, so the cost is linear and no pairs come out.
    ``incidents``: ``incident_id, service, first_seen, last_seen``;
    ``changes``: ``change_id, service, ts``.
    """
    span = F.expr(f"interval {within}")
    no_id = F.lit(None).cast("string")

    def probe(name: str, ts: Column, rank: int) -> DataFrame:
        return incidents.select(
            "service", ts.alias("ts"), F.lit(rank).alias("rank"), F.lit(name).alias("probe"),
            "incident_id", F.lit(None).cast(changes.schema["change_id"].dataType).alias("change_id"),
        )

    points = (
        changes.select(
            "service", "ts", F.lit(1).alias("rank"), no_id.alias("probe"),
            no_id.alias("incident_id"), "change_id",
        )
        .unionByName(probe("low", F.col("first_seen") - span, 0))
        .unionByName(probe("at", F.col("first_seen"), 2))
        .unionByName(probe("high", F.col("last_seen"), 2))
    )
    order = F.struct("ts", "rank", "probe", "incident_id", "change_id")
    seen = with_running(
        stored(points, "change-probes"), ["service"], order, F.date_trunc("hour", "ts"),
        {
            "changes": Running("sum", F.when(F.col("change_id").isNotNull(), 1).otherwise(0)),
            "nearest": Running("max", F.when(F.col("change_id").isNotNull(), F.struct("ts", "change_id"))),
        },
    ).filter(F.col("probe").isNotNull())

    def at(name: str, value: str) -> Column:
        return F.max(F.when(F.col("probe") == name, F.col(value)))

    per_incident = seen.groupBy("incident_id").agg(
        F.first("service").alias("service"),
        (at("high", "changes") - at("low", "changes")).alias("changes_in_window"),
        at("at", "nearest").alias("nearest"),
        at("at", "ts").alias("first_seen"),
    )
    close = F.col("nearest.ts") >= F.col("first_seen") - span
    return per_incident.select(
        "incident_id", "service", "first_seen", "changes_in_window",
        F.when(close, F.col("nearest.change_id")).alias("nearest_change_id"),
        F.when(close, F.col("nearest.ts")).alias("nearest_change_ts"),
    )


def changes_before(incidents: DataFrame, changes: DataFrame, within: str = "6 hours") -> DataFrame:
    """Every change of an incident's service in ``[first_seen - within, first_seen]``, one row each.

    An equi-join on service and time bucket of the look-back's length, then the exact bounds: an incident meets
    the changes of two buckets only. Columns: ``incident_id, change_id, ts``.
    """
    span = F.expr(f"interval {within}")
    origin = F.lit("1970-01-01").cast("timestamp")
    length = F.unix_micros(origin + span)

    def bucket(ts: Column) -> Column:
        return F.floor(F.unix_micros(ts) / length)

    own = incidents.select(
        "incident_id", "service", "first_seen",
        F.explode(F.array(bucket(F.col("first_seen")) - 1, bucket(F.col("first_seen")))).alias("_bucket"))
    near = changes.select("service", "change_id", "ts", bucket(F.col("ts")).alias("_bucket"))
    close = (F.col("ts") >= F.col("first_seen") - span) & (F.col("ts") <= F.col("first_seen"))
    return own.join(near, ["service", "_bucket"]).filter(close).select("incident_id", "change_id", "ts")
