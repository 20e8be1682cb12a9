"""Registered queries: clusters, incidents, anomalies, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import anomalies as an
from faultline.operators import clusters as cl
from faultline.operators import families as fam
from faultline.operators import incidents as inc
from faultline.plans import log_view as lv
from faultline.session import stored

CUTOFF = "2024-01-16"


def clusters(spark, sf_dir):
    """C-01..C-04, C-06, C-08: one row per signature."""
    return cl.clusters(lv.kept(spark, sf_dir)).drop("first_seen_iso", "last_seen_iso")


CLUSTERS = "with " + lv.CLUSTERS_SQL + """
select signature, count, first_seen, last_seen, sample_message, severity from c"""


def clusters_by_time(spark, sf_dir):
    """C-07: the same with the earliest timestamp as first_seen."""
    return cl.clusters(lv.kept(spark, sf_dir), by_time=True).select("signature", "count", "first_seen", "last_seen")


def cluster_running(spark, sf_dir):
    """C-05: the cluster as of every error event."""
    return cl.running_clusters(lv.kept(spark, sf_dir)).select(
        "seq", "signature", "count", "first_seen", "last_seen", "sample_message", "cluster_severity"
    )


RUNNING = "with " + lv.CLUSTERS_SQL + """
select seq, signature, row_number() over w as count, first_value(ts) over w as first_seen, max(ts) over w as last_seen,
  first_value(message) over w as sample_message, first_value(severity) over w as cluster_severity
from e window w as (partition by signature order by seq rows between unbounded preceding and current row)"""


def incidents(spark, sf_dir):
    """I-01..I-05, I-07: one row per incident with its latest cluster."""
    rows = inc.incidents(lv.kept(spark, sf_dir))
    return rows.select(
        "incident_id", "signature", "detected_at", "service", "environment", "affected_component", "severity",
        F.col("error_cluster.count").alias("count"), F.col("error_cluster.first_seen").alias("first_seen"),
        F.col("error_cluster.last_seen").alias("last_seen"),
    )


INCIDENTS = "with " + lv.INCIDENTS_SQL + """
select incident_id, signature, detected_at, service, environment, affected_component, severity, count, first_seen, last_seen from i"""


def incidents_at_trigger(spark, sf_dir):
    """P-16 (point in time): the cluster as it was when the incident came up."""
    rows = inc.incidents(lv.kept(spark, sf_dir), as_of="trigger")
    return rows.select(
        "incident_id", F.col("error_cluster.count").alias("count"),
        F.col("error_cluster.last_seen").alias("last_seen"),
        F.col("error_cluster.last_seen_iso").alias("last_seen_iso"),
    )


AT_TRIGGER = "with " + lv.INCIDENTS_SQL + """
select incident_id, cast(case log_severity when 'CRITICAL' then 1 else 2 end as bigint) as count,
  greatest(first_seen, detected_at) as last_seen, case when first_seen >= detected_at then first_seen_iso else detected_at_iso end as last_seen_iso
from i"""


def incident_updates(spark, sf_dir):
    """I-04: every event at or past the threshold, new once per signature."""
    return inc.incident_updates(lv.kept(spark, sf_dir)).select(
        "seq", "incident_id", "count", "last_seen", "severity", "is_new"
    )


UPDATES = "with " + lv.CLUSTERS_SQL + """,
r as (select *, row_number() over w as count, first_value(ts_iso) over w as first_iso, max(ts) over w as last_seen,
  first_value(severity) over w as head_severity
  from e window w as (partition by signature order by seq rows between unbounded preceding and current row)),
t as (select *, case head_severity when 'CRITICAL' then 1 else 2 end as threshold from r)
select seq, substr(sha256(signature || '|' || first_iso), 1, 16) as incident_id, count, last_seen,
  case head_severity when 'CRITICAL' then 'critical' else 'high' end as severity, count = threshold as is_new
from t where count >= threshold"""


def severity_map(spark, sf_dir):
    """I-02: events per log severity and business severity."""
    from faultline.functions.keys import business_severity

    return lv.kept(spark, sf_dir).groupBy(
        "severity", business_severity(F.col("severity")).alias("impact")
    ).agg(F.count(F.lit(1)).alias("events"))


SEVERITY_MAP = "with " + lv.KEPT_SQL + """
select severity, case severity when 'CRITICAL' then 'critical' when 'ERROR' then 'high' when 'WARNING' then 'medium' else 'low' end as impact,
  count(*) as events from kept group by 1, 2"""


def error_rate_spikes(spark, sf_dir):
    """I-08: error rate per service and hour against the 24 windows before."""
    return an.error_rate_spikes(lv.kept(spark, sf_dir))


_HOURS = """,
h as (select service, date_trunc('hour', ts) as window_start, count(*) as total,
  count(*) filter (where severity in ('ERROR', 'CRITICAL')) as errors, count(*) filter (where severity = 'CRITICAL') as critical
  from kept group by 1, 2)"""

SPIKES = "with " + lv.KEPT_SQL + _HOURS + """,
b as (select *, errors / total as r, count(*) over w as baseline_windows, avg(errors / total) over w as base,
  stddev_samp(errors / total) over w as spread
  from h window w as (partition by service order by window_start rows between 24 preceding and 1 preceding))
select service, window_start, total, errors, baseline_windows, round(r, 6) as rate, round(base, 6) as baseline,
  coalesce(r > base + 3.0 * spread and errors >= 2 and baseline_windows >= 3, false) as is_spike from b"""


def new_signatures(spark, sf_dir):
    """I-09: clusters of the second half whose signature the first half lacks."""
    events = lv.kept(spark, sf_dir)
    prior = cl.error_events(events).filter(F.col("ts") < F.lit(CUTOFF).cast("timestamp")).select("signature").distinct()
    current = cl.clusters(events.filter(F.col("ts") >= F.lit(CUTOFF).cast("timestamp")))
    return an.new_signatures(current, prior).select("signature", "count", "first_seen", "severity")


NEW_SIGNATURES = "with " + lv.CLUSTERS_SQL + f"""
select signature, count(*) as count, arg_min(ts, seq) as first_seen, arg_min(severity, seq) as severity from e
where ts >= timestamp '{CUTOFF}' and signature not in (select signature from e where ts < timestamp '{CUTOFF}') group by signature"""


def severity_shift(spark, sf_dir):
    """I-10: share of error events per service and hour against the hour before."""
    return an.severity_shift(lv.kept(spark, sf_dir))


SHIFT = "with " + lv.KEPT_SQL + _HOURS + """,
q as (select *, round(errors / total, 6) as share from h),
g as (select *, lag(share) over (partition by service order by window_start) as previous_share from q)
select service, window_start, total, errors, critical, share, previous_share,
  coalesce(round(share - previous_share, 6) >= 0.25 and errors >= 3, false) as is_elevated from g"""


def _spans(spark, sf_dir):
    """Incidents as intervals, from the first occurrence to the trigger."""
    rows = inc.incidents(lv.kept(spark, sf_dir), as_of="trigger")
    spans = rows.select(
        "incident_id", "service", F.col("error_cluster.first_seen").alias("first_seen"),
        F.col("error_cluster.last_seen").alias("last_seen"),
    )
    return stored(spans, "incident-spans")


_SPANS_SQL = lv.INCIDENTS_SQL + """,
spans as (select incident_id, service, first_seen, greatest(first_seen, detected_at) as last_seen from i)"""


def incident_overlap(spark, sf_dir):
    """I-11: incidents of a service whose times chain together."""
    return an.incident_groups(_spans(spark, sf_dir))


OVERLAP = "with " + _SPANS_SQL + """,
o as (select *, max(last_seen) over (partition by service order by first_seen, incident_id rows between unbounded preceding and 1 preceding) as reached from spans),
p as (select *, case when reached is null or first_seen > reached then first_seen end as start from o)
select incident_id, service, first_seen, last_seen,
  max(start) over (partition by service order by first_seen, incident_id rows between unbounded preceding and current row) as group_start from p"""


def incident_group_sizes(spark, sf_dir):
    """I-11: groups of more than one incident."""
    return an.group_sizes(an.incident_groups(_spans(spark, sf_dir)))


GROUP_SIZES = OVERLAP.replace("select incident_id, service, first_seen, last_seen,\n", ", g as (select incident_id, service, first_seen, last_seen,\n") + """)
select service, group_start, count(*) as incidents, max(last_seen) as group_end from g group by 1, 2 having count(*) > 1"""


def incident_families(spark, sf_dir):
    """I-11: similar incidents of different signatures in a chain of overlapping times, and the earliest of them."""
    rows = stored(inc.incidents(lv.kept(spark, sf_dir), as_of="trigger").select(
        "incident_id", "service", F.col("error_cluster.first_seen").alias("first_seen"),
        F.col("error_cluster.last_seen").alias("last_seen"),
        fam.wording(F.col("trigger.error_type"), F.col("trigger.stack_trace"), F.col("affected_component"),
                    F.col("trigger.message")).alias("wording")), "incident-wordings")
    chains = an.incident_groups(rows).select("incident_id", "group_start")
    return fam.incident_families(rows.join(chains, "incident_id"))


FAMILIES = OVERLAP.replace("select incident_id, service, first_seen, last_seen,\n", ", g as (select incident_id, service, first_seen, last_seen,\n") + r"""),
x as (select g.incident_id, g.service, g.group_start, g.first_seen, list_distinct(list_filter(string_split(
    coalesce(i.error_type || ' ', '') || coalesce(list_extract(regexp_extract_all(i.stack_trace, 'File "[^"]*", line \d+, in (\w+)', 1), -1), 'unknown')
    || ' ' || coalesce(i.affected_component || ' ', '') || regexp_replace(regexp_replace(i.message, '''[^'']*''|"[^"]*"', '<str>', 'g'), '\d+', '#', 'g'),
    ' '), lambda word: word <> '')) as words
  from g join i using (incident_id)),
y as (select a.incident_id, b.incident_id as other, b.first_seen as other_seen
  from x a join x b on a.service = b.service and a.group_start = b.group_start
  where a.incident_id = b.incident_id
    or 100 * len(list_intersect(a.words, b.words)) >= 80 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))))
select incident_id, any_value(x.service) as service, any_value(x.group_start) as group_start, count(*) - 1 as similar_incidents,
  arg_min(other, (other_seen, other)) as head_id
from y join x using (incident_id) group by incident_id"""


def changes(spark, sf_dir):
    """Change events out of orders: a service and a minute in the month of the logs."""
    orders = lv.table(spark, sf_dir, "orders")
    minute = (F.col("o_orderkey") * 7 % 43200).cast("int")
    return orders.select(
        F.col("o_orderkey").alias("change_id"),
        F.concat(F.lit("svc-"), (F.col("o_custkey") % 5).cast("string")).alias("service"),
        F.timestamp_add("MINUTE", minute, F.lit("2024-01-01").cast("timestamp")).alias("ts"),
    )


CHANGES_SQL = """,
changes as (select o_orderkey as change_id, 'svc-' || (o_custkey % 5) as service,
  timestamp '2024-01-01' + to_minutes(cast(o_orderkey * 7 % 43200 as int)) as ts from orders)"""


def correlated_changes(spark, sf_dir):
    """P-18: changes near each incident, counted, and the nearest one before it."""
    return an.correlated_changes(_spans(spark, sf_dir), changes(spark, sf_dir))


CORRELATED = "with " + _SPANS_SQL + CHANGES_SQL + """
select incident_id, s.service, first_seen,
  count(*) filter (where c.ts is not null) as changes_in_window,
  arg_max(change_id, (c.ts, change_id)) filter (where c.ts <= first_seen) as nearest_change_id,
  max(c.ts) filter (where c.ts <= first_seen) as nearest_change_ts
from spans s left join changes c on c.service = s.service and c.ts between first_seen - interval 6 hour and last_seen
group by 1, 2, 3"""



def changes_before(spark, sf_dir):
    """P-18: every change of the look-back before each incident."""
    return an.changes_before(_spans(spark, sf_dir), changes(spark, sf_dir))


BEFORE = "with " + _SPANS_SQL + CHANGES_SQL + """
select incident_id, change_id, c.ts from spans s join changes c on c.service = s.service
  and c.ts between first_seen - interval 6 hour and first_seen"""

QUERIES = {
    "clusters": (clusters, CLUSTERS),
    "clusters_by_time": (clusters_by_time, "with " + lv.CLUSTERS_SQL + """
select signature, count(*) as count, min(ts) as first_seen, max(ts) as last_seen from e group by signature"""),
    "cluster_running": (cluster_running, RUNNING),
    "incidents": (incidents, INCIDENTS),
    "incidents_at_trigger": (incidents_at_trigger, AT_TRIGGER),
    "incident_updates": (incident_updates, UPDATES),
    "severity_map": (severity_map, SEVERITY_MAP),
    "error_rate_spikes": (error_rate_spikes, SPIKES),
    "new_signatures": (new_signatures, NEW_SIGNATURES),
    "severity_shift": (severity_shift, SHIFT),
    "incident_overlap": (incident_overlap, OVERLAP),
    "incident_group_sizes": (incident_group_sizes, GROUP_SIZES),
    "incident_families": (incident_families, FAMILIES),
    "correlated_changes": (correlated_changes, CORRELATED),
    "changes_before": (changes_before, BEFORE),
}
