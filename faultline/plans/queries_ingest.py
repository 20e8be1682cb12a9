"""Registered queries: raw lines to events (sources, validation, identity, dedup)."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import (
    message_template, redact, redaction_count, strip_space, top_frame, truncate_head, truncate_tail,
)
from faultline.functions.once import with_computed
from faultline.operators import dedup
from faultline.operators.ingest import OK, ingest, parse, validate
from faultline.operators.stats import ingest_counters
from faultline.plans import log_view as lv
from faultline.sources import event_store
from faultline.sources.event_store import retrieve
from faultline.session import shared_folder, stored
from faultline.sources.log_lines import nonblank
from faultline.sources.mappings import CLOUD_ENTRY


def _ingested(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return ingest(lv.raw(spark, sf_dir), columns=columns)


def record_lines(spark, sf_dir):
    """S-01, S-02: document texts cut into lines, stripped, blank ones dropped."""
    lines = lv.table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.split("text", "\n")).alias("value")
    )
    return nonblank(lines).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.length("value")).alias("chars")
    )


RECORD_LINES = r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
s as (select doc_id, regexp_replace(line, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g') as value from l)
select doc_id, count(*) as records, cast(sum(length(value)) as bigint) as chars from s where length(value) > 0 group by doc_id"""


def ingest_status(spark, sf_dir):
    """T-01..T-05, T-10, T-15, S-05: disposition and reason of every raw row."""
    return validate(parse(lv.raw(spark, sf_dir))).select("seq", "status", "error")


def ingest_stats(spark, sf_dir):
    """T-14: run counters."""
    return ingest_counters(_ingested(spark, sf_dir, "event_id"))


INGEST_STATS = lv.INGESTED_SQL + """
, a as (select count(*) filter (where status = 'malformed_json') as malformed, count(*) filter (where status = 'invalid_schema') as invalid,
  count(*) filter (where status in ('invalid_type', 'unsupported_source')) as quarantined,
  count(*) filter (where status = 'ok') - count(distinct event_id) as duplicate, count(*) filter (where status = 'ok') as processed from ing)
select counter, value from a unpivot (value for counter in (malformed, invalid, quarantined, duplicate, processed))"""


def _cloud_raw(spark, sf_dir):
    """Log events as entries of a cloud provider: structured and plain payloads, some of them flawed."""
    rows = lv.view(spark, sf_dir)
    number = F.col("seq")
    labels = F.struct(
        F.col("environment"), F.lit("eu-1").alias("zone"),
        F.when(number % 13 == 0, "t-1").alias("access_token"))
    resource = F.struct(F.lit("run").alias("type"), F.struct(
        F.when(number % 37 != 0, F.col("service")).alias("service_name"), F.col("version").alias("revision_name"),
        F.lit("shadowed").alias("zone")).alias("labels"))
    structured = F.when(number % 2 == 0, F.struct(
        "message", "error_type", "stack_trace", "request_id", "endpoint", F.col("k").alias("code"),
        F.lit("other").alias("event_id")))
    severity = (
        F.when(number % 53 == 0, "FATAL").when(F.col("severity") == "CRITICAL", "EMERGENCY")
        .when(F.col("severity") == "DEBUG", "NOTICE").when(F.col("severity") != "INFO", F.col("severity")))
    entry = F.to_json(F.struct(
        F.when(number % 3 != 0, F.col("event_id")).alias("insertId"), F.col("ts_iso").alias("timestamp"),
        severity.alias("severity"), resource.alias("resource"), labels.alias("labels"), structured.alias("jsonPayload"),
        F.when(number % 2 != 0, F.col("message")).alias("textPayload"),
        F.concat(F.lit("projects/p/traces/t-"), F.col("event_id")).alias("trace"),
        F.when(number % 5 == 0, F.lit(500)).otherwise(F.lit(None)).alias("spanId")))
    payload = F.when(number % 41 == 0, "[]").otherwise(entry)
    source = F.when(number % 43 == 0, "elsewhere").otherwise("cloud")
    return with_computed(rows, payload.alias("payload"), source.alias("source")).select("seq", "payload", "source")


def cloud_entries(spark, sf_dir):
    """S-05: records of a second format, read by their declared layout and checked like all others."""
    rows = ingest(
        _cloud_raw(spark, sf_dir), layouts={"cloud": CLOUD_ENTRY},
        columns=("event_id", "severity", "service", "environment", "version", "message", "error_type", "request_id",
                 "trace_id", "endpoint", "metadata"))
    return rows.select(
        "seq", "status", "error", "event_id", "severity", "service", "environment", "version", F.md5("message").alias("message_md5"),
        "error_type", "request_id", "trace_id", "endpoint",
        F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("metadata_keys"),
        F.try_variant_get(F.col("metadata")["zone"], "$", "string").alias("zone"))


CLOUD_ENTRIES = "with " + lv.VIEW_SQL + r""",
p as (select seq, case when seq % 43 = 0 then 'elsewhere' else 'cloud' end as source, case when seq % 41 = 0 then '[]' else json_object(
    'insertId', case when seq % 3 <> 0 then event_id end, 'timestamp', ts_iso,
    'severity', case when seq % 53 = 0 then 'FATAL' when severity = 'CRITICAL' then 'EMERGENCY' when severity = 'DEBUG' then 'NOTICE'
      when severity <> 'INFO' then severity end,
    'resource', json_object('type', 'run', 'labels', json_object('service_name', case when seq % 37 <> 0 then service end,
      'revision_name', version, 'zone', 'shadowed')),
    'labels', json_object('environment', environment, 'zone', 'eu-1', 'access_token', case when seq % 13 = 0 then 't-1' end),
    'jsonPayload', case when seq % 2 = 0 then json_object('message', message, 'error_type', error_type, 'stack_trace', stack_trace,
      'request_id', request_id, 'endpoint', endpoint, 'code', k, 'event_id', 'other') end,
    'textPayload', case when seq % 2 <> 0 then message end, 'trace', 'projects/p/traces/t-' || event_id,
    'spanId', case when seq % 5 = 0 then 500 end)::varchar end as payload from v),
r as (select seq, source, payload::json as doc from p),
f as (select *, json_extract_string(doc, '$.insertId') as f_id, json_extract_string(doc, '$.timestamp') as f_time,
    case coalesce(json_extract_string(doc, '$.severity'), 'INFO') when 'EMERGENCY' then 'CRITICAL' when 'ALERT' then 'CRITICAL'
      when 'NOTICE' then 'INFO' when 'DEFAULT' then 'INFO' else coalesce(json_extract_string(doc, '$.severity'), 'INFO') end as f_severity,
    json_extract_string(doc, '$.resource.labels.service_name') as f_service,
    coalesce(json_extract_string(doc, '$.jsonPayload.message'), json_extract_string(doc, '$.textPayload')) as f_message,
    json_extract_string(doc, '$.jsonPayload.request_id') as f_request from r),
s as (select *, case when json_type(doc) <> 'OBJECT' or f_service is null or f_severity = 'FATAL' then 'invalid_schema'
    when json_extract_string(doc, '$.spanId') is not null then 'invalid_type' else 'ok' end as status from f),
t as (select *, case when json_type(doc) <> 'OBJECT' then 'payload is not a JSON object'
    when source <> 'cloud' then 'missing required field(s): ' || case when json_extract_string(doc, '$.severity') is null then 'severity, ' else '' end || 'service, message'
    when f_service is null then 'missing required field(s): service' when f_severity = 'FATAL' then 'invalid severity: ''FATAL'''
    when status = 'invalid_type' then 'not a string: span_id' end as error,
  case when status = 'ok' then true end as good from s)
select seq, case when source <> 'cloud' then 'invalid_schema' else status end as status, error,
  case when u then coalesce(nullif(f_id, ''), sha256(f_time || '|' || f_service || '|' || f_severity || '|' || f_message || '|' || coalesce(f_request, ''))) end as event_id,
  case when u then f_severity end as severity, case when u then f_service end as service,
  case when u then json_extract_string(doc, '$.labels.environment') end as environment,
  case when u then json_extract_string(doc, '$.resource.labels.revision_name') end as version, case when u then md5(f_message) end as message_md5,
  case when u then json_extract_string(doc, '$.jsonPayload.error_type') end as error_type, case when u then f_request end as request_id,
  case when u then regexp_replace(json_extract_string(doc, '$.trace'), '^.*/', '') end as trace_id,
  case when u then json_extract_string(doc, '$.jsonPayload.endpoint') end as endpoint,
  case when u then case when seq % 2 = 0 then 'code,' else '' end
    || case when json_extract_string(doc, '$.jsonPayload.endpoint') is not null then 'endpoint,' else '' end || 'zone' end as metadata_keys,
  case when u then json_extract_string(doc, '$.labels.zone') end as zone
from (select *, coalesce(good, false) and source = 'cloud' as u from t)"""


def dispositions(spark, sf_dir):
    """T-15 with D-01: the same rows with later arrivals marked as duplicates."""
    rows = stored(_ingested(spark, sf_dir, "event_id").select("seq", "event_id", "status"), "ingested")
    return dedup.with_duplicates_marked(rows).select("seq", "event_id", "status")


def event_identity(spark, sf_dir):
    """T-07, T-11: identity and raw reference of every accepted event."""
    return _ingested(spark, sf_dir, "event_id", "raw_ref").filter(F.col("status") == OK).select("seq", "event_id", "raw_ref")


def event_times(spark, sf_dir):
    """T-05: instant and exact text of every accepted event's timestamp."""
    return _ingested(spark, sf_dir, "ts", "ts_iso").filter(F.col("status") == OK).select("seq", "ts", "ts_iso")


def metadata_sanitized(spark, sf_dir):
    """T-06, T-08: metadata keys left after split and credential removal."""
    rows = _ingested(spark, sf_dir, "metadata").filter(F.col("status") == OK)
    return rows.select(
        "seq", F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("metadata_keys")
    )


METADATA = lv.INGESTED_SQL + """
select seq, array_to_string(list_sort(list_filter(json_keys(doc), lambda key: key not in ('event_id', 'timestamp', 'severity', 'service',
  'environment', 'version', 'message', 'error_type', 'error_message', 'stack_trace', 'request_id', 'trace_id', 'span_id', 'raw_ref')
  and not regexp_matches(lower(key), 'authorization|cookie|password|api_key|apikey|token|secret'))), ',') as metadata_keys
from ing where status = 'ok'"""


def redact_text(spark, sf_dir):
    """T-09: secret-shaped values removed from whole document texts."""
    rows = with_computed(lv.table(spark, sf_dir, "documents").select("doc_id", "text"), redact(F.col("text")).alias("redacted"))
    return rows.select(
        "doc_id", F.md5("redacted").alias("redacted_md5"),
        redaction_count(F.col("text"), F.col("redacted")).cast("bigint").alias("redactions"),
    )


def redacted_events(spark, sf_dir):
    """T-09 in the flow: documents as log messages, as ingest stores them."""
    docs = lv.table(spark, sf_dir, "documents").filter("text <> ''")
    record = F.to_json(F.struct(
        F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("ERROR").alias("severity"), F.lit("svc").alias("service"),
        F.col("doc_id").cast("string").alias("event_id"), F.col("text").alias("message"), F.col("text").alias("note")))
    raw = docs.select(F.col("doc_id").alias("seq"), record.alias("payload"), F.lit("local").alias("source"))
    rows = ingest(raw, columns=("message", "metadata"))
    note = F.try_variant_get(F.col("metadata")["note"], "$", "string")
    return rows.select("seq", "status", F.md5("message").alias("message_md5"), F.md5(note).alias("note_md5"))


def _redact_sql(column: str) -> str:
    from faultline.functions.text import REDACTED, SECRET_PATTERNS

    out = column
    for _, pattern, keep in SECRET_PATTERNS:
        quoted = pattern.replace("'", "''")
        mark = ("\\1" if keep else "") + REDACTED
        out = f"regexp_replace({out}, '{quoted}', '{mark}', 'g')"
    return out


REDACT = f"""
with r as (select doc_id, text, {_redact_sql('text')} as out from documents)
select doc_id, md5(out) as redacted_md5,
  cast((length(out) - length(replace(out, '[REDACTED]', ''))) // 10 - (length(text) - length(replace(text, '[REDACTED]', ''))) // 10 as bigint)
  as redactions from r"""


REDACTED_EVENTS = f"""
select doc_id as seq, 'ok' as status, md5({_redact_sql('text')}) as message_md5, md5({_redact_sql('text')}) as note_md5
from documents where text <> ''"""


def truncate_modes(spark, sf_dir):
    """P-02: head and tail truncation of whole document texts."""
    text = F.col("text")
    return lv.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(truncate_head(text, 500)).alias("head_md5"),
        F.md5(truncate_tail(text, 2000)).alias("tail_md5"),
    )


TRUNCATE = """
select doc_id, md5(case when length(text) > 500 then left(text, 500) || '...[truncated]' else text end) as head_md5,
  md5(case when length(text) > 2000 then '...[truncated]...' || chr(10) || right(text, 2000) else text end) as tail_md5 from documents"""


def message_templates(spark, sf_dir):
    """T-12: messages per template, UUIDs in a fifth of them."""
    uuid = F.regexp_replace(F.md5("event_id"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    message = F.when(F.col("seq") % 5 == 0, F.concat("message", F.lit(" in "), uuid)).otherwise(F.col("message"))
    rows = lv.deliveries(spark, sf_dir).select(message.alias("message"))
    return rows.groupBy(message_template(F.col("message")).alias("template")).agg(F.count(F.lit(1)).alias("messages"))


MESSAGE_TEMPLATES = "with " + lv.DELIVERIES_SQL + r"""
select regexp_replace(regexp_replace(regexp_replace(case when seq % 5 = 0 then message || ' in ' ||
    regexp_replace(md5(event_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') else message end,
  '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '<uuid>', 'g'),
  '''[^'']*''|"[^"]*"', '<str>', 'g'), '\d+', '#', 'g') as template, count(*) as messages
from d group by 1"""


def document_templates(spark, sf_dir):
    """T-12 over free text: template of every whole document."""
    return lv.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(message_template(F.col("text"))).alias("template_md5")
    )


DOCUMENT_TEMPLATES = r"""
select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text,
  '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '<uuid>', 'g'), '''[^'']*''|"[^"]*"', '<str>', 'g'),
  '\p{Nd}+', '#', 'g')) as template_md5 from documents"""


def top_frames(spark, sf_dir):
    """T-13: events per innermost frame."""
    return lv.deliveries(spark, sf_dir).groupBy(top_frame(F.col("stack_trace")).alias("frame")).agg(
        F.count(F.lit(1)).alias("events")
    )


TOP_FRAMES = "with " + lv.DELIVERIES_SQL + r"""
select coalesce(list_extract(regexp_extract_all(stack_trace, 'File "[^"]*", line \d+, in (\w+)', 1), -1), 'unknown') as frame,
  count(*) as events from d group by 1"""


def event_retrieval(spark, sf_dir):
    """S-06: events of some services and severities in a time range."""
    found = retrieve(
        lv.kept(spark, sf_dir), services=["svc-1", "svc-3"], severities=["ERROR", "CRITICAL"],
        start=datetime(2024, 1, 5), end=datetime(2024, 1, 20),
    )
    return found.select("event_id", "ts", "service", "severity", "signature")


RETRIEVAL = "with " + lv.KEPT_SQL + """
select event_id, ts, service, severity, signature from kept where service in ('svc-1', 'svc-3') and severity in ('ERROR', 'CRITICAL')
  and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'"""


def request_events(spark, sf_dir):
    """S-06: events of four requests and of one service's hour, looked up in the laid-out event table."""
    events = lv.kept(spark, sf_dir).select("event_id", "ts", "service", "severity", "request_id")
    folder = shared_folder(spark)
    if folder is not None:
        path = f"{folder}/events-{uuid.uuid4()}"
        event_store.lay_out(stored(events, "kept"), path)
        events = event_store.read_events(spark, path).drop(event_store.DAY)
    asked = event_store.look_up(events, "request_id", ["req-1", "req-77", "req-1003", "req-4", None])
    hour = retrieve(events, services=["svc-2"], start=datetime(2024, 1, 9, 6), end=datetime(2024, 1, 9, 7))
    return asked.withColumn("asked", F.lit("request")).unionByName(hour.withColumn("asked", F.lit("hour")))


REQUEST_EVENTS = "with " + lv.KEPT_SQL + """
select event_id, ts, service, severity, request_id, 'request' as asked from kept where request_id in ('req-1', 'req-77', 'req-1003', 'req-4')
union all
select event_id, ts, service, severity, request_id, 'hour' from kept
  where service = 'svc-2' and ts >= timestamp '2024-01-09 06:00:00' and ts < timestamp '2024-01-09 07:00:00'"""


def dedup_first(spark, sf_dir):
    """D-01, D-04: first arrival of each id."""
    return dedup.first_arrivals(
        lv.deliveries(spark, sf_dir).filter(F.col("kind") == "ok")
    ).select("event_id", "seq", "ts")


def _user_stream(spark, sf_dir):
    rows = lv.view(spark, sf_dir)
    return rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("event_id"), "ts", "seq")


def dedup_ttl(spark, sf_dir):
    """D-02: first arrival per id within six hours, on the events' own clock."""
    return dedup.first_within_ttl(_user_stream(spark, sf_dir), ttl_seconds=6 * 3600)


DEDUP_TTL = """
with recursive p as (select 'u' || user_id as event_id, ts, min(event_id) as seq from events group by 1, 2),
k(event_id, ts, seq) as (
  select event_id, min(ts), arg_min(seq, ts) from p group by event_id
  union all
  select p.event_id, min(p.ts), arg_min(p.seq, p.ts) from k join p on p.event_id = k.event_id and p.ts > k.ts + interval 6 hour
  group by p.event_id)
select event_id, ts, seq from k"""

QUERIES = {
    "record_lines": (record_lines, RECORD_LINES),
    "ingest_status": (ingest_status, "with " + lv.INGESTED_SQL + " select seq, status, error from ing"),
    "ingest_stats": (ingest_stats, "with " + INGEST_STATS),
    "cloud_entries": (cloud_entries, CLOUD_ENTRIES),
    "dispositions": (dispositions, "with " + lv.INGESTED_SQL + """
select seq, event_id, case when status = 'ok' and row_number() over (partition by status, event_id order by seq) > 1
  then 'duplicate' else status end as status from ing"""),
    "event_identity": (event_identity, "with " + lv.INGESTED_SQL + " select seq, event_id, event_id as raw_ref from ing where status = 'ok'"),
    "event_times": (event_times, "with " + lv.INGESTED_SQL + """
select seq, cast(replace(f_timestamp, '+00:00', '') as timestamp) as ts, f_timestamp as ts_iso from ing where status = 'ok'"""),
    "metadata_sanitized": (metadata_sanitized, "with " + METADATA),
    "redact_text": (redact_text, REDACT),
    "redacted_events": (redacted_events, REDACTED_EVENTS),
    "truncate_modes": (truncate_modes, TRUNCATE),
    "message_templates": (message_templates, MESSAGE_TEMPLATES),
    "document_templates": (document_templates, DOCUMENT_TEMPLATES),
    "top_frames": (top_frames, TOP_FRAMES),
    "event_retrieval": (event_retrieval, RETRIEVAL),
    "request_events": (request_events, REQUEST_EVENTS),
    "dedup_first": (dedup_first, "with " + lv.DELIVERIES_SQL + """
select event_id, seq, ts from (select *, row_number() over (partition by event_id order by seq) as rn from d where kind = 'ok') where rn = 1"""),
    "dedup_ttl": (dedup_ttl, DEDUP_TTL),
}
