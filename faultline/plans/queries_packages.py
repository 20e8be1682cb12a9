"""Registered queries: prompts, analyses, packages, reports, conformance."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import analysis as ana
from faultline.operators import incidents as inc
from faultline.operators import packages as pk
from faultline.operators import versions as vs
from faultline.operators.conformance import check_packages
from faultline.plans import log_view as lv
from faultline.session import stored


def _incidents(spark, sf_dir):
    return stored(inc.incidents(lv.kept(spark, sf_dir)), "incidents")


def _has_analysis():
    return F.substring("incident_id", 1, 1) < "8"


def analyses(incidents):
    """Synthetic analysis rows for about half of the incidents."""
    count = F.col("error_cluster.count")

    def hypothesis(name, confidence):
        return F.struct(F.lit(name).alias("statement"), confidence.cast("double").alias("confidence"))

    return incidents.filter(_has_analysis()).select(
        "incident_id",
        F.concat(F.lit("Summary of "), "incident_id").alias("summary"),
        F.concat(F.lit("Impact on "), "service").alias("impact_description"),
        F.array(F.lit("errors"), F.col("severity")).alias("symptoms"),
        F.array(F.lit("seen")).alias("observed_facts"),
        F.array(
            hypothesis("first", (count % 10) / 10), hypothesis("second", (count * 3 % 10) / 10),
            hypothesis("third", F.lit(0.5)),
        ).alias("hypotheses"),
        F.array(F.lit("check deploys"), F.lit("check inputs")).alias("recommended_investigation"),
    )


ANALYSES_SQL = lv.INCIDENTS_SQL + """,
a as (select *, substr(incident_id, 1, 1) < '8' as analyzed, (count % 10) / 10.0::double as c1, (count * 3 % 10) / 10.0::double as c2 from i),
p as (select *, case when analyzed then case when c1 >= c2 and c1 >= 0.5 then 'first' when c2 >= 0.5 then 'second' else 'third' end end as cause,
  case when analyzed then greatest(c1, c2, 0.5::double) else 0.0::double end as confidence,
  service || ' ' || coalesce(nullif(trim(affected_component, '/'), '') || ' ', '') || 'requests are failing with ' ||
    coalesce(error_type, 'an unspecified error') || '.' || case when analyzed then ' Summary of ' || incident_id else '' end as summary,
  regexp_replace(first_seen_iso, '\\+00:00$', 'Z') as first_z, regexp_replace(last_seen_iso, '\\+00:00$', 'Z') as last_z,
  regexp_replace(detected_at_iso, '\\+00:00$', 'Z') as detected_z from a)""".replace("\\\\", "\\")


def _packages(spark, sf_dir):
    rows = _incidents(spark, sf_dir)
    return pk.build_packages(rows, analyses(rows))


def package_summary(spark, sf_dir):
    """P-06..P-08, P-12, P-13: one row per package, degraded ones included."""
    return _packages(spark, sf_dir).select(
        "incident_id", "schema_version", "severity", "detected_at", "summary",
        F.col("impact.metric").alias("metric"), F.col("impact.value").alias("value"),
        F.col("impact.description").alias("impact_description"),
        "suspected_root_cause", "confidence_overall",
        F.col("deployment_information.version").alias("version"),
        F.array_join("log_references", ",").alias("log_references"),
        F.array_join("symptoms", ",").alias("symptoms"),
        F.size("hypotheses").cast("bigint").alias("hypotheses"),
        (F.size("correlated_events") + F.size("related_incident_ids") + F.size("relevant_files")
         + F.size("documentation_context")).cast("bigint").alias("left_empty"),
    )


SUMMARY = "with " + ANALYSES_SQL + """
select incident_id, '1.1' as schema_version, severity, detected_z as detected_at, summary, 'occurrence_count' as metric,
  cast(count as varchar) as value, case when analyzed then 'Impact on ' || service end as impact_description,
  cause as suspected_root_cause, confidence as confidence_overall, version, raw_ref as log_references,
  case when analyzed then 'errors,' || severity else '' end as symptoms, cast(case when analyzed then 3 else 0 end as bigint) as hypotheses,
  cast(0 as bigint) as left_empty from p"""


def package_clusters(spark, sf_dir):
    """P-09, P-16 (latest): the cluster inside each package."""
    rows = _packages(spark, sf_dir).select("incident_id", F.explode("error_clusters").alias("c"))
    return rows.select("incident_id", "c.signature", "c.count", "c.first_seen", "c.last_seen", "c.sample_message", "c.severity")


def package_facts(spark, sf_dir):
    """P-10: facts in order, each with its evidence."""
    rows = _packages(spark, sf_dir).select("incident_id", F.posexplode("observed_facts").alias("pos", "fact"))
    first = F.col("fact.evidence")[0]
    return rows.select(
        "incident_id", F.col("pos").cast("bigint").alias("pos"), F.col("fact.statement").alias("statement"),
        F.size("fact.evidence").cast("bigint").alias("evidence"),
        first["log_query_or_reference"].alias("reference"), first["timestamp"].alias("at"), first["count"].alias("count"),
    )


FACTS = "with " + ANALYSES_SQL + """,
u as (
  select incident_id, 1 as ord, coalesce(error_type, 'This error') || ' occurred ' || count || ' time(s) in service ''' || service || '''' ||
    coalesce(' (' || environment || ')', '') as statement, 1 as evidence, raw_ref as reference, last_z as "at", count as count from p
  union all select incident_id, 2, 'First observed at ' || first_seen_iso || ', most recently at ' || last_seen_iso || '.', 2, null, first_z, null from p
  union all select incident_id, 3, 'Requests to ''' || affected_component || ''' were affected' || coalesce(' (HTTP ' || http_status || ')', '') || '.',
    1, raw_ref, detected_z, null from p where affected_component is not null
  union all select incident_id, 4, 'The error message was: ' || error_message, 1, raw_ref, detected_z, null from p where error_message is not null
  union all select incident_id, 5, 'At least one occurrence was recorded under request_id ''' || request_id || '''.', 1, raw_ref, detected_z, null
    from p where request_id is not null)
select incident_id, row_number() over (partition by incident_id order by ord) - 1 as pos, statement, cast(evidence as bigint) as evidence,
  reference, "at", count from u"""


def package_timeline(spark, sf_dir):
    """P-11: timeline entries in order."""
    rows = _packages(spark, sf_dir).select("incident_id", F.posexplode("timeline").alias("pos", "entry"))
    return rows.select("incident_id", F.col("pos").cast("bigint").alias("pos"), "entry.timestamp", "entry.event")


TIMELINE = "with " + ANALYSES_SQL + """,
u as (
  select incident_id, 1 as ord, first_seen as t, first_z as timestamp, 'First occurrence observed' as event from p
  union all select incident_id, 2, last_seen, last_z, 'Most recent occurrence observed' from p where last_seen <> first_seen
  union all select incident_id, 3, detected_at, detected_z, 'Detector detected this as an incident' from p)
select incident_id, row_number() over (partition by incident_id order by t, ord) - 1 as pos, timestamp, event from u"""


def top_hypothesis(spark, sf_dir):
    """P-12: leading hypothesis, earliest among equals."""
    rows = analyses(_incidents(spark, sf_dir)).withColumn("top", pk.top_hypothesis(F.col("hypotheses")))
    return rows.select("incident_id", "top.statement", "top.confidence")


def package_keys(spark, sf_dir):
    """P-14: keys of the JSON form, absent values left out."""
    rows = pk.package_json(_packages(spark, sf_dir))
    return rows.select("incident_id", F.array_join(F.array_sort(F.json_object_keys("package")), ",").alias("json_keys"))


KEYS = "with " + ANALYSES_SQL + """
select incident_id, array_to_string(list_sort(list_filter(['incident_id', 'schema_version', 'severity', 'detected_at',
  case when environment is not null then 'environment' end, 'service', case when affected_component is not null then 'affected_component' end,
  'impact', 'summary', 'symptoms', 'error_clusters', 'observed_facts', 'correlated_events', 'timeline', 'hypotheses',
  case when analyzed then 'suspected_root_cause' end, 'confidence_overall', case when version is not null then 'deployment_information' end,
  'relevant_files', 'documentation_context', 'recommended_investigation', 'log_references', 'related_incident_ids'],
  lambda s: s is not null)), ',') as json_keys from p"""


def package_violations(spark, sf_dir):
    """P-15: packages with planted flaws and what the check says."""
    rows = pk.package_json(_packages(spark, sf_dir))
    text, first = F.col("package"), F.substring("incident_id", 1, 1)
    planted = (
        F.when(first == "0", F.replace(text, F.lit('"schema_version":"1.1"'), F.lit('"schema_version":"2.0"')))
        .when(first == "1", F.replace(text, F.lit('"confidence_overall":'), F.lit('"confidence":')))
        .when(first == "2", F.regexp_replace(text, '"confidence_overall":[0-9.]+', '"confidence_overall":1.5'))
        .when(first == "3", F.replace(text, F.lit('"timeline":[{"timestamp"'), F.lit('"timeline":[{"at"')))
        .when(first == "4", F.concat(text, F.lit("}")))
        .otherwise(text)
    )
    checked = check_packages(rows.select("incident_id", planted.alias("package")))
    return checked.select("incident_id", F.array_join("violations", "; ").alias("violations"))


VIOLATIONS = "with " + lv.INCIDENTS_SQL + """
select incident_id, case substr(incident_id, 1, 1) when '0' then 'not 1.1: schema_version'
  when '1' then 'missing: confidence_overall; unknown: confidence' when '2' then 'not in [0, 1]: confidence_overall'
  when '3' then 'wrong items: timeline' when '4' then 'not a JSON object' else '' end as violations from i"""


def _plain_packages(rows):
    """Small package documents whose nested types go wrong by the number of occurrences."""
    n, q = F.col("error_cluster.count"), '"'
    at = F.concat(F.lit(q), F.col("trigger.ts_iso"), F.lit(q))
    detected = F.when(n % 3 == 0, '"yesterday"').otherwise(at)
    count = F.when(n % 4 == 0, '"2"').otherwise(n.cast("string"))
    level, event, value = (F.when(n % k == 0, bad).otherwise(good) for k, bad, good in (
        (5, '"huge"', '"high"'), (7, "5", '"e"'), (2, "1.5", '"v"')))
    return rows.select("incident_id", F.concat(
        F.lit('{"schema_version":"1.1","severity":"high","service":"s","summary":"x","confidence_overall":0.5,"observed_facts":[],"incident_id":"'),
        "incident_id", F.lit('","detected_at":'), detected, F.lit(',"impact":{"value":'), value, F.lit('},"error_clusters":[{"signature":"s","count":'),
        count, F.lit(',"first_seen":'), at, F.lit(',"last_seen":'), at, F.lit(',"severity":'), level, F.lit('}],"timeline":[{"timestamp":'), at,
        F.lit(',"event":'), event, F.lit("}]}")).alias("package"))


def package_type_violations(spark, sf_dir):
    """P-15: wrong types inside package documents."""
    checked = check_packages(_plain_packages(_incidents(spark, sf_dir)))
    return checked.select("incident_id", F.array_join("violations", "; ").alias("violations"))


TYPE_VIOLATIONS = "with " + lv.INCIDENTS_SQL + r""",
texts as (select incident_id, cast('{"detected_at":' || case when count % 3 = 0 then '"yesterday"' else '"' || detected_at_iso || '"' end ||
  ',"impact":{"value":' || case when count % 2 = 0 then '1.5' else '"v"' end || '},"error_clusters":[{"count":' ||
  case when count % 4 = 0 then '"2"' else cast(count as varchar) end || ',"severity":' || case when count % 5 = 0 then '"huge"' else '"high"' end ||
  '}],"timeline":[{"event":' || case when count % 7 = 0 then '5' else '"e"' end || '}]}' as json) as doc from i)
select incident_id, concat_ws('; ', case when json_type(doc, '$.impact.value') <> 'VARCHAR' then 'wrong object: impact' end,
  case when json_type(doc, '$.error_clusters[0].count') not in ('UBIGINT', 'BIGINT')
    or json_extract_string(doc, '$.error_clusters[0].severity') not in ('critical', 'high', 'medium', 'low', 'CRITICAL', 'ERROR', 'WARNING', 'INFO', 'DEBUG')
    then 'wrong items: error_clusters' end,
  case when json_type(doc, '$.timeline[0].event') <> 'VARCHAR' then 'wrong items: timeline' end,
  case when not regexp_matches(json_extract_string(doc, '$.detected_at'), '^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$')
    then 'not a time: detected_at' end) as violations from texts"""


def prompt_text(spark, sf_dir):
    """P-01, P-02, P-03: prompt of every incident as it came up, with its metadata."""
    user = F.col("user_id").cast("string")
    metadata = F.concat(F.lit('{"user":'), user, F.lit(',"token":"t","note":"n '), user, F.lit('","code":'), F.col("k").cast("string"), F.lit("}"))
    events = lv.kept(spark, sf_dir).withColumn("metadata", F.try_parse_json(metadata).try_cast("map<string,variant>"))
    rows = inc.incidents(events, as_of="trigger")
    return ana.prompts(rows).select("incident_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("chars"))


PROMPT = "with " + lv.INCIDENTS_SQL + r""",
q as (select incident_id, concat_ws(chr(10), 'Incident evidence (deterministic):', 'service: ' || service, 'environment: ' || coalesce(environment, 'None'),
  'affected_component: ' || coalesce(affected_component, 'None'), 'severity: ' || severity, 'signature: ' || signature,
  'occurrence_count: ' || case log_severity when 'CRITICAL' then 1 else 2 end, 'first_seen: ' || first_seen_iso,
  'last_seen: ' || case when first_seen >= detected_at then first_seen_iso else detected_at_iso end, 'sample_message: ' || sample_message, '',
  'Representative log event (one example occurrence):', 'timestamp: ' || ts_iso, 'error_type: ' || coalesce(error_type, 'None'),
  'error_message: ' || coalesce(error_message, 'None'), 'message: ' || message, 'request_id: ' || coalesce(request_id, 'None'),
  'trace_id: ' || coalesce(trace_id, 'None'), 'version: ' || coalesce(version, 'None'), 'metadata: {"code":' || k || ',"note":"n ' || user_id || '","user":' || user_id || '}', 'stack_trace:', stack_trace, '') as prompt
  from (select i.*, e.k, e.user_id from i join e on e.seq = i.trigger_seq))
select incident_id, md5(prompt) as prompt_md5, length(prompt) as chars from q"""


def pending_analysis(spark, sf_dir):
    """P-05: incidents the analysis table does not hold yet."""
    rows = _incidents(spark, sf_dir)
    return ana.prompts(rows, analyses(rows)).select("incident_id")


def analysis_responses(spark, sf_dir):
    """P-04: responses with flaws by the number of occurrences, which are valid, and their leading numbers."""
    n = F.col("error_cluster.count")
    summary = F.when(n % 5 == 0, "5").otherwise('"s"')
    symptoms = F.when(n % 7 == 0, "[5]").when(n % 7 == 1, '"x"').otherwise('["x","y"]')
    confidence = F.when(n % 11 == 0, "1.5").when(n % 11 == 1, '"0.5"').otherwise("0.25")
    body = F.concat(
        F.lit('{"summary":'), summary, F.lit(',"impact_description":"i","symptoms":'), symptoms,
        F.lit(',"observed_facts":[],"hypotheses":[{"statement":"h","confidence":'), confidence,
        F.lit('}],"recommended_investigation":["r"],"extra":1}'),
        F.when(n % 13 == 0, " trailing").otherwise(""),
    )
    parsed = ana.parse_responses(_incidents(spark, sf_dir).select("incident_id", body.alias("response")))
    return parsed.select(
        "incident_id", "valid", F.array_join("symptoms", ",").alias("symptoms"),
        F.col("hypotheses")[0]["confidence"].alias("confidence"),
    )


RESPONSES = "with " + lv.INCIDENTS_SQL + """,
bodies as (select incident_id, '{"summary":' || case when count % 5 = 0 then '5' else '"s"' end || ',"symptoms":' ||
  case count % 7 when 0 then '[5]' when 1 then '"x"' else '["x","y"]' end || ',"confidence":' ||
  case count % 11 when 0 then '1.5' when 1 then '"0.5"' else '0.25' end || '}' || case when count % 13 = 0 then ' trailing' else '' end as body from i),
docs as (select incident_id, case when json_valid(body) then cast(body as json) end as doc from bodies),
judged as (select incident_id, doc, coalesce(json_type(doc, '$.summary') = 'VARCHAR' and json_type(doc, '$.symptoms') = 'ARRAY'
  and json_type(doc, '$.symptoms[0]') = 'VARCHAR' and json_type(doc, '$.confidence') in ('DOUBLE', 'UBIGINT', 'BIGINT')
  and cast(json_extract_string(doc, '$.confidence') as double) between 0 and 1, false) as valid from docs)
select incident_id, valid, case when valid then array_to_string(json_extract_string(doc, '$.symptoms[*]'), ',') end as symptoms,
  case when valid then cast(json_extract_string(doc, '$.confidence') as double) end as confidence from judged"""


def report_text(spark, sf_dir):
    """P-17: the short report of every package."""
    return pk.report_text(_packages(spark, sf_dir)).select("incident_id", F.md5("report").alias("report_md5"))


REPORT = "with " + ANALYSES_SQL + r""",
t as (select incident_id, '[INCIDENT]' || chr(10) || summary || chr(10) || 'Severity: ' || severity || chr(10) || 'Occurrences: ' || count ||
  chr(10) || chr(10) || '[HYPOTHESIS]' || chr(10) || coalesce(cause, '(none -- insufficient evidence)') || chr(10) || chr(10) || '[CONFIDENCE]' || chr(10) ||
  format('{:.2f}', confidence) || case when analyzed then chr(10) || chr(10) || '[RECOMMENDED INVESTIGATION]' || chr(10) || '- check deploys' || chr(10) ||
  '- check inputs' else '' end as report from p)
select incident_id, md5(report) as report_md5 from t"""

#: The moment of the as-of query.
AS_OF = "2024-01-16 12:00:00"


def package_as_of(spark, sf_dir):
    """P-16: the package of each incident as it was at one moment, with the time that version held."""
    events = lv.kept(spark, sf_dir)
    then = stored(vs.as_of(vs.history(events), F.lit(AS_OF).cast("timestamp")), "versions-as-of")
    rows = stored(vs.incidents_of(events, then), "incidents-as-of")
    packages = pk.build_packages(rows.drop("version"), analyses(rows))
    clusters = packages.select("incident_id", F.explode("error_clusters").alias("c"))
    return clusters.join(then.select("incident_id", "version", "valid_from", "valid_to"), "incident_id").select(
        "incident_id", "version", "valid_from", "valid_to", "c.count", "c.first_seen", "c.last_seen")


PACKAGE_AS_OF = "with " + lv.CLUSTERS_SQL + f""",
r as (select *, row_number() over w as count, first_value(ts_iso) over w as first_iso, max(ts) over w as valid_from,
  arg_max(ts_iso, ts) over w as last_iso, first_value(severity) over w as head_severity
  from e window w as (partition by signature order by seq rows between unbounded preceding and current row)),
known as (select *, case head_severity when 'CRITICAL' then count else count - 1 end as number,
  lead(valid_from) over (partition by signature order by seq) as valid_to from r)
select substr(sha256(signature || '|' || first_iso), 1, 16) as incident_id, number as version, valid_from, valid_to, count,
  regexp_replace(first_iso, '\\+00:00$', 'Z') as first_seen, regexp_replace(last_iso, '\\+00:00$', 'Z') as last_seen
from known where number >= 1 and valid_from <= timestamp '{AS_OF}' and (valid_to is null or valid_to > timestamp '{AS_OF}')"""

QUERIES = {
    "package_summary": (package_summary, SUMMARY),
    "package_clusters": (package_clusters, "with " + ANALYSES_SQL + """
select incident_id, signature, count, first_z as first_seen, last_z as last_seen, sample_message, severity from p"""),
    "package_as_of": (package_as_of, PACKAGE_AS_OF),
    "package_facts": (package_facts, FACTS),
    "package_timeline": (package_timeline, TIMELINE),
    "top_hypothesis": (top_hypothesis, "with " + ANALYSES_SQL + " select incident_id, cause as statement, confidence from p where analyzed"),
    "package_keys": (package_keys, KEYS),
    "package_violations": (package_violations, VIOLATIONS),
    "package_type_violations": (package_type_violations, TYPE_VIOLATIONS),
    "prompt_text": (prompt_text, PROMPT),
    "pending_analysis": (pending_analysis, "with " + lv.INCIDENTS_SQL + " select incident_id from i where substr(incident_id, 1, 1) >= '8'"),
    "analysis_responses": (analysis_responses, RESPONSES),
    "report_text": (report_text, REPORT),
}
