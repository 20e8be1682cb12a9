"""Registered queries: gate, outbox, delivery attempts, lifecycle, verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.operators import gate, incidents, lifecycle, outbox, packages
from faultline.plans import log_view as lv
from faultline.plans.queries_packages import analyses
from faultline.session import stored
from faultline.sources.json_documents import parse_results


def _first():
    return F.substring("incident_id", 1, 1)


def _incidents(spark, sf_dir):
    return stored(incidents.incidents(lv.kept(spark, sf_dir)), "incidents")


def _packages(rows):
    return packages.build_packages(rows, analyses(rows))


def _results(rows):
    """Synthetic investigation results, one per incident, flawed by its first digit."""
    first, none = _first(), F.lit(None).cast("string")
    verdict = F.when(first == "2", "refuted").when(first == "5", "maybe").when(first == "7", "partially_confirmed").otherwise("confirmed")
    assessment = F.struct(
        F.lit("cause").alias("statement"),
        F.when(first == "6", 2.0).otherwise(0.4).alias("prior_confidence"),
        verdict.alias("verdict"), F.array(F.lit("log line")).alias("evidence"),
    )
    no_text = F.array().cast("array<string>")
    return rows.select(
        F.when(first == "4", F.reverse("incident_id")).otherwise(F.col("incident_id")).alias("incident_id"),
        F.array(assessment).alias("hypothesis_assessments"), no_text.alias("additional_facts"),
        F.when(first == "0", none).when(first == "1", "  ").otherwise("a cause").alias("validated_root_cause"),
        no_text.alias("root_cause_evidence"),
        F.when(first == "3", "undetermined").when(first == "8", "openspec").otherwise("lightweight").alias("planning_path"),
        F.lit("").alias("planning_path_reason"), no_text.alias("undetermined"),
    )


_RESULTS_SQL = lv.INCIDENTS_SQL + """,
g as (select case substr(incident_id, 1, 1) when '4' then reverse(incident_id) else incident_id end as incident_id, incident_id as package_id,
  substr(incident_id, 1, 1) as first from i),
z as (select *, case first when '5' then 'not in domain: verdict' when '6' then 'not in [0, 1]: prior_confidence' else '' end as violations,
  case when first in ('0', '1') then '{no_cause}' when first in ('2', '5') then '{no_verdict}' when first = '3' then '{undetermined}'
    else '{authorized}' end as reason from g)""".format(**{
    name: text.replace("'", "''") for name, text in {
        "no_cause": fv.REASON_NO_CAUSE, "no_verdict": fv.REASON_NO_VERDICT,
        "undetermined": fv.REASON_UNDETERMINED, "authorized": fv.REASON_AUTHORIZED,
    }.items()
})


def gate_decisions(spark, sf_dir):
    """G-01, G-02: violations, decision and reason of every result."""
    found = incidents.incidents(lv.kept(spark, sf_dir), as_of="trigger")
    rows = gate.with_decision(_results(found))
    return rows.select("incident_id", F.array_join(gate.result_violations(), "; ").alias("violations"), "authorized", "reason")


GATE = "with " + _RESULTS_SQL + """
select incident_id, violations, first not in ('0', '1', '2', '3', '5') as authorized, reason from z"""


def _result_texts(rows):
    """Result documents whose types go wrong by the number of occurrences."""
    n = F.col("error_cluster.count")
    cause = (F.when(n % 5 == 0, n.cast("string")).when(n % 5 == 1, "true").when(n % 5 == 2, '{"a":1}').when(n % 5 == 3, "null")
             .otherwise('"a cause"'))
    reason = F.when(n % 7 == 0, "1").otherwise('"r"')
    facts = F.when(n % 11 == 0, "null").when(n % 11 == 1, "[5]").otherwise('["f"]')
    verdict = F.when(n % 13 == 0, "2").otherwise('"confirmed"')
    return rows.select("incident_id", F.concat(
        F.lit('{"incident_id":"'), "incident_id", F.lit('","hypothesis_assessments":[{"statement":"s","prior_confidence":0.5,"verdict":'),
        verdict, F.lit(',"evidence":[]}],"validated_root_cause":'), cause, F.lit(',"planning_path":"lightweight","planning_path_reason":'),
        reason, F.lit(',"additional_facts":'), facts, F.lit("}")).alias("text"))


def result_violations(spark, sf_dir):
    """S-07, G-01: wrong types in result documents, and what the gate makes of them."""
    found = incidents.incidents(lv.kept(spark, sf_dir))
    rows = gate.with_decision(parse_results(_result_texts(found).withColumnRenamed("incident_id", "file")))
    types = F.filter("violations", lambda v: v.startswith("not a"))
    return rows.select(F.col("file").alias("incident_id"), F.array_join(types, "; ").alias("violations"), "authorized")


RESULT_VIOLATIONS = "with " + lv.INCIDENTS_SQL + """,
flawed as (select incident_id, cast('{"verdict":' || case when count % 13 = 0 then '2' else '"confirmed"' end || ',"cause":' || case count % 5
    when 0 then cast(count as varchar) when 1 then 'true' when 2 then '{"a":1}' when 3 then 'null' else '"a cause"' end ||
  ',"reason":' || case when count % 7 = 0 then '1' else '"r"' end || ',"facts":' || case count % 11 when 0 then 'null' when 1 then '[5]' else '["f"]' end
  || '}' as json) as d from i),
kinds as (select incident_id, json_type(d, '$.cause') as cause, json_type(d, '$.reason') as reason, json_type(d, '$.facts') as facts,
  json_type(d, '$.facts[0]') as fact, json_type(d, '$.verdict') as verdict, json_extract_string(d, '$.cause') as text from flawed),
judged as (select *, concat_ws('; ', case when cause not in ('VARCHAR', 'NULL') then 'not a string: validated_root_cause' end,
  case when reason <> 'VARCHAR' then 'not a string: planning_path_reason' end,
  case when verdict <> 'VARCHAR' then 'not a list of assessments: hypothesis_assessments' end,
  case when facts <> 'ARRAY' or fact <> 'VARCHAR' then 'not a list of strings: additional_facts' end) as violations from kinds)
select incident_id, violations, violations = '' and cause = 'VARCHAR' and trim(text) <> '' as authorized from judged"""


def package_match(spark, sf_dir):
    """G-03: packages and results by incident."""
    rows = _incidents(spark, sf_dir)
    return gate.match(_packages(rows), _results(rows))


MATCH = "with " + _RESULTS_SQL + """
select coalesce(i.incident_id, z.incident_id) as incident_id,
  case when z.incident_id is null then 'no_result' when i.incident_id is null then 'no_package' else 'matched' end as match
from i full join z on z.incident_id = i.incident_id"""


def _deliveries(found):
    first = _first()
    rows = found.filter(first.isin("8", "9", "a"))
    kind = F.when(first == "a", "incident-implement").otherwise("incident-investigate")
    status = F.when(first == "9", 503).otherwise(204)
    return rows.select(kind.alias("event_type"), "incident_id", status.alias("status_code"))


def dispatch_outbox(spark, sf_dir):
    """G-04, G-05: what is still to send, each with the id its payload carries."""
    found = _incidents(spark, sf_dir)
    docs, done = _packages(found), _deliveries(found)
    rows = outbox.investigate_outbox(docs, done).unionByName(
        outbox.implement_outbox(docs, _results(found), done)
    )
    return rows.select(
        "event_type", "incident_id",
        F.get_json_object("payload", "$.incident_package.incident_id").alias("package_id"),
        F.get_json_object("payload", "$.investigation_result.planning_path").alias("planning_path"),
    )


OUTBOX = "with " + _RESULTS_SQL + """
select 'incident-investigate' as event_type, package_id as incident_id, package_id, null as planning_path from z where first <> '8'
union all
select 'incident-implement', z.incident_id, z.incident_id, case first when '8' then 'openspec' else 'lightweight' end
from z join i on i.incident_id = z.incident_id where violations = '' and first not in ('0', '1', '2', '3', 'a')"""


def _attempts(spark, sf_dir):
    k = F.col("k")
    status = F.when(k % 6 == 0, 204).when(k % 6 == 1, 503).when(k % 6 == 2, 403).when(k % 6 == 3, 429).when(k % 6 == 4, 404)
    rows = lv.view(spark, sf_dir)
    return rows.select(
        F.lit("incident-investigate").alias("event_type"), F.expr("concat('a', seq div 3)").alias("incident_id"),
        (F.col("seq") % 3 + 1).alias("attempt"), status.alias("status_code"), F.col("ts").alias("attempted_at"),
    ).filter((F.col("attempt") < 3) | F.col("status_code").isNull() | (F.col("status_code") != 403))


def dispatch_retry(spark, sf_dir):
    """G-06: state and next time of every delivery, from its attempts."""
    return outbox.attempt_state(_attempts(spark, sf_dir))


RETRY = "with " + lv.VIEW_SQL + """,
t as (select 'incident-investigate' as event_type, 'a' || (seq // 3) as incident_id, seq % 3 + 1 as attempt,
  case k % 6 when 0 then 204 when 1 then 503 when 2 then 403 when 3 then 429 when 4 then 404 end as status_code, ts from v),
u as (select * from t where attempt < 3 or status_code is null or status_code <> 403),
l as (select event_type, incident_id, max(attempt) as attempts, bool_or(coalesce(status_code between 200 and 299, false)) as delivered,
  max(ts) as ts from u group by 1, 2),
w as (select l.*, u.status_code, not delivered and attempts < 3 and (u.status_code is null or u.status_code in (429, 500, 502, 503, 504)) as due
  from l join u on u.incident_id = l.incident_id and u.attempt = l.attempts)
select event_type, incident_id, attempts, status_code, case when delivered then 'delivered' when due then 'retry_due' else 'final_failure' end as state,
  case when due then ts + to_seconds(attempts) end as next_attempt_at from w"""


def handoff_losses(spark, sf_dir):
    """G-07: packages that lost a field on the way."""
    sent = packages.package_json(_packages(_incidents(spark, sf_dir)))
    cut = F.when(_first() == "0", F.regexp_replace("package", '"symptoms":\\[[^\\]]*\\],', ""))
    received = sent.filter(_first() != "1").select("incident_id", F.coalesce(cut, "package").alias("package"))
    return outbox.lost_fields(sent, received)


_STATES = (
    "DETECTED", "CONTEXT_READY", "CODEX_INVESTIGATING", "FIX_IN_PROGRESS", "PR_OPEN", "REVIEWING", "CHANGES_REQUESTED",
    "REVIEWING", "READY_FOR_HUMAN", "MERGED", "VERIFYING", "RESOLVED", "FAILED",
)


def _transitions(spark, sf_dir):
    """Histories per user: mostly the regular order of states, with some jumps."""
    rows = lv.view(spark, sf_dir)
    names = F.array(*[F.lit(s) for s in _STATES])
    step = F.expr("user_id + seq div 150 + case when k % 9 = 0 then 3 else 0 end") % len(_STATES)
    return rows.select(
        "seq", F.concat(F.lit("i-"), F.col("user_id").cast("string")).alias("incident_id"),
        F.element_at(names, (step + 1).cast("int")).alias("state"),
    )


_TRANSITIONS_SQL = lv.VIEW_SQL + """,
h as (select seq, 'i-' || user_id as incident_id,
  [{states}][cast((user_id + seq // 150 + case when k % 9 = 0 then 3 else 0 end) % {n} + 1 as int)] as state from v)""".format(
    states=", ".join(f"'{s}'" for s in _STATES), n=len(_STATES)
)


def lifecycle_current(spark, sf_dir):
    """L-01: current state of each history."""
    return lifecycle.current_states(_transitions(spark, sf_dir))


def lifecycle_steps(spark, sf_dir):
    """L-01: every step, legal or not."""
    return lifecycle.checked_steps(_transitions(spark, sf_dir))


LEGAL = "with " + _TRANSITIONS_SQL + """,
o as (select *, lag(state) over (partition by incident_id order by seq) as previous from h)
select seq, incident_id, previous, state, (previous is null and state = 'DETECTED') or (previous is not null and state = 'FAILED')
  or coalesce((previous, state) in ({steps}), false) as is_legal from o""".format(
    steps=", ".join(f"('{a}', '{b}')" for a, b in fv.LIFECYCLE_STEPS)
)


def retry_cap(spark, sf_dir):
    """L-02: requests for changes with the attempts before them."""
    return lifecycle.remediation_routes(_transitions(spark, sf_dir))


CAP = "with " + _TRANSITIONS_SQL + """
select seq, incident_id, row_number() over (partition by incident_id order by seq) - 1 as attempts_before,
  case when row_number() over (partition by incident_id order by seq) - 1 < 3 then 'RETRY' else 'HUMAN_ATTENTION_REQUIRED' end as route
from h where state = 'CHANGES_REQUESTED'"""


def review_route(spark, sf_dir):
    """L-03: route of every labelled item."""
    rows = lv.view(spark, sf_dir).select(
        F.expr("seq div 4").alias("item_id"), F.when(F.expr("seq div 4") % 3 == 0, "other").otherwise("incident-fix").alias("label"),
        F.col("severity").isin("ERROR", "CRITICAL").alias("blocking"), (F.col("k") % 2 == 0).alias("resolved"),
    )
    return lifecycle.review_routes(rows, "incident-fix")


ROUTE = "with " + lv.VIEW_SQL + """,
t as (select seq // 4 as item_id, severity in ('ERROR', 'CRITICAL') and k % 2 <> 0 as open_block from v where (seq // 4) % 3 <> 0)
select item_id, count(*) as findings, count(*) filter (where open_block) as open_blocking,
  case when bool_or(open_block) then 'REMEDIATE' else 'HUMAN_REVIEW' end as route from t group by 1"""


def _outcomes(spark, sf_dir):
    events = lv.kept(spark, sf_dir)
    rows = incidents.incidents(events, as_of="trigger")
    lag = F.when(_first() < "8", F.expr("interval 20 days")).otherwise(F.expr("interval 29 days"))
    deployments = rows.select(
        "incident_id", "signature", "service", (F.col("error_cluster.first_seen") + lag).alias("deployed_at"),
        F.array(F.lit("fn_1"), F.lit("fn_2"), F.lit("fn_3")).alias("touched"),
    )
    spans = stored(lifecycle.signature_spans(events), "signature-spans")
    return lifecycle.outcomes(deployments, spans, lifecycle.service_traffic(events))


def verify_outcome(spark, sf_dir):
    """L-04: outcome of each fix."""
    return _outcomes(spark, sf_dir)


_OUTCOME_SQL = lv.INCIDENTS_SQL + r""",
dep as (select incident_id, signature, service, first_seen + case when substr(incident_id, 1, 1) < '8' then interval 20 day else interval 29 day end as deployed_at from i),
sg as (select signature, arg_min(service, seq) as service, arg_min(list_extract(regexp_extract_all(stack_trace, 'in (\w+)', 1), -1), seq) as frame,
  min(ts) as first_seen, max(ts) as last_seen from e group by 1),
nw as (select service, max(first_seen) as newest, arg_max(signature, (first_seen, signature)) as newest_signature from sg group by 1),
nf as (select service, max(first_seen) as newest, arg_max(signature, (first_seen, signature)) as fix_signature from sg
  where frame in ('fn_1', 'fn_2', 'fn_3') group by 1),
tr as (select service, max(ts) as last_ts from kept group by 1),
oc as (select dep.*, case when sg.last_seen >= deployed_at then 'PERSISTING' when nf.newest >= deployed_at then 'REGRESSED'
    when nw.newest >= deployed_at then 'CHANGED' when last_ts >= deployed_at + interval 24 hour then 'RESOLVED' else 'IN_PROGRESS' end as outcome,
  newest_signature, fix_signature
  from dep left join sg using (signature) left join nw on nw.service = dep.service left join nf on nf.service = dep.service left join tr on tr.service = dep.service),
os as (select incident_id, service, deployed_at, outcome, case outcome when 'PERSISTING' then signature when 'REGRESSED' then fix_signature
  when 'CHANGED' then newest_signature end as symptom_signature from oc)"""


def follow_ups(spark, sf_dir):
    """L-05: follow-up incidents linked to the original."""
    rows = lifecycle.follow_ups(_outcomes(spark, sf_dir))
    return rows.withColumn("related_incident_ids", F.array_join("related_incident_ids", ","))


FOLLOW = "with " + _OUTCOME_SQL + """
select substr(sha256(incident_id || '|' || outcome || '|' || strftime(deployed_at, '%Y-%m-%dT%H:%M:%S.%f')), 1, 16) as incident_id, service, outcome,
  symptom_signature, incident_id as related_incident_ids from os where outcome in ('PERSISTING', 'CHANGED', 'REGRESSED')"""

QUERIES = {
    "result_violations": (result_violations, RESULT_VIOLATIONS),
    "gate_decisions": (gate_decisions, GATE),
    "package_match": (package_match, MATCH),
    "dispatch_outbox": (dispatch_outbox, OUTBOX),
    "dispatch_retry": (dispatch_retry, RETRY),
    "handoff_losses": (handoff_losses, "with " + lv.INCIDENTS_SQL + " select incident_id from i where substr(incident_id, 1, 1) in ('0', '1')"),
    "lifecycle_current": (lifecycle_current, "with " + _TRANSITIONS_SQL + """
select incident_id, arg_max(state, seq) as state, count(*) as steps from h group by 1"""),
    "lifecycle_steps": (lifecycle_steps, LEGAL),
    "retry_cap": (retry_cap, CAP),
    "review_route": (review_route, ROUTE),
    "verify_outcome": (verify_outcome, "with " + _OUTCOME_SQL + " select * from os"),
    "follow_ups": (follow_ups, FOLLOW),
}
