"""Log tables derived from the ``events`` table, the same in Spark and in SQL.

``view`` gives typed log rows, ``deliveries`` adds redelivered copies, ``kept``
the first arrivals; ``raw`` writes rows as JSON text with planted flaws. Each
has its SQL twin as a chain of CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.once import with_computed
from faultline.functions.timestamps import utc_iso
from faultline.operators.clusters import with_signature
from faultline.operators.dedup import first_arrivals

REDELIVERED = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` over all cores where their files give fewer splits than that, as they are otherwise.

    For costly expressions on a small scan: one row group is one task however many cores there are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", "event_type", "props")
    events = dealt(scan, "event_id").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    text = F.col("event_id").cast("string")
    k = F.col("k")
    return events.select(
        F.col("event_id").alias("seq"), text.alias("event_id"), "ts", utc_iso(F.col("ts")).alias("ts_iso"),
        "user_id", "value", "k",
        F.when(F.col("event_id") % 97 == 0, "malformed_json")
        .when(F.col("event_id") % 89 == 0, "invalid_schema").otherwise("ok").alias("kind"),
        F.when(
            F.col("event_type") == "error",
            F.when(F.col("event_id") % 29 == 0, "CRITICAL").otherwise("ERROR"),
        ).when(F.col("event_type") == "purchase", "WARNING")
        .when(F.col("event_type") == "signup", "DEBUG").otherwise("INFO").alias("severity"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service"),
        F.when(F.col("user_id") % 3 == 0, "production").when(F.col("user_id") % 3 == 1, "staging")
        .alias("environment"),
        F.concat(
            F.lit("Request "), text, F.lit(" for user 'u"), F.col("user_id").cast("string"),
            F.lit("' failed with code "), k.cast("string"),
        ).alias("message"),
        F.when(k % 4 == 0, "ZeroDivisionError").when(k % 4 == 1, "KeyError")
        .when(k % 4 == 2, "TimeoutError").alias("error_type"),
        F.when(k % 3 == 0, "/checkout").when(k % 3 == 1, "/orders").alias("endpoint"),
        F.concat(
            F.lit('File "app/main.py", line '), text, F.lit(", in handler\nFile \"app/lib.py\", line 7, in fn_"),
            k.cast("string"),
        ).alias("stack_trace"),
        F.when(k % 5 != 0, F.concat(F.lit("code "), k.cast("string"))).alias("error_message"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("req-"), text)).alias("request_id"),
        F.lit(None).cast("string").alias("trace_id"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("v"), (k % 3).cast("string"))).alias("version"),
        F.when(k % 7 != 0, "500").alias("http_status"),
        F.concat(F.lit("log/"), text).alias("raw_ref"),
    )


VIEW_SQL = r"""
v as (
  select event_id as seq, cast(event_id as varchar) as event_id, ts,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when microsecond(ts) % 1000000 = 0 then '' else strftime(ts, '.%f') end
      || '+00:00' as ts_iso,
    user_id, value, k,
    case when event_id % 97 = 0 then 'malformed_json' when event_id % 89 = 0 then 'invalid_schema' else 'ok' end as kind,
    case event_type when 'error' then case when event_id % 29 = 0 then 'CRITICAL' else 'ERROR' end
                    when 'purchase' then 'WARNING' when 'signup' then 'DEBUG' else 'INFO' end as severity,
    'svc-' || cast(user_id % 5 as varchar) as service,
    case user_id % 3 when 0 then 'production' when 1 then 'staging' end as environment,
    'Request ' || event_id || ' for user ''u' || user_id || ''' failed with code ' || k as message,
    case k % 4 when 0 then 'ZeroDivisionError' when 1 then 'KeyError' when 2 then 'TimeoutError' end as error_type,
    case k % 3 when 0 then '/checkout' when 1 then '/orders' end as endpoint,
    'File "app/main.py", line ' || event_id || ', in handler' || chr(10) || 'File "app/lib.py", line 7, in fn_' || k as stack_trace,
    case when k % 5 <> 0 then 'code ' || k end as error_message,
    case when event_id % 4 <> 0 then 'req-' || event_id end as request_id,
    cast(null as varchar) as trace_id,
    case when event_id % 2 = 0 then 'v' || (k % 3) end as version,
    case when k % 7 <> 0 then '500' end as http_status,
    'log/' || event_id as raw_ref
  from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)
)"""


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view plus a second delivery of every eleventh event, later in order."""
    rows = view(spark, sf_dir)
    again = F.when(F.col("seq") % 11 == 0, F.array(F.lit(0), F.lit(REDELIVERED))).otherwise(F.array(F.lit(0)))
    return (
        rows.withColumn("_shift", F.explode(again))
        .withColumn("seq", F.col("seq") + F.col("_shift"))
        .drop("_shift")
    )


DELIVERIES_SQL = VIEW_SQL + f""",
d as (select * from v union all select * replace ({REDELIVERED} + seq as seq) from v where seq % 11 = 0)"""


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First arrivals of the well-formed deliveries, with their signature."""
    return with_signature(first_arrivals(deliveries(spark, sf_dir).filter(F.col("kind") == "ok")))


SIGNATURE_SQL = r"""
    coalesce(nullif(environment, ''), 'unknown') || ':' || service || ':' || coalesce(nullif(error_type, ''), 'unknown') || ':' ||
    coalesce(list_extract(regexp_extract_all(stack_trace, 'File "[^"]*", line \d+, in (\w+)', 1), -1), 'unknown') || ':' ||
    regexp_replace(regexp_replace(regexp_replace(message,
      '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}', '<uuid>', 'g'),
      '''[^'']*''|"[^"]*"', '<str>', 'g'), '\d+', '#', 'g') || ':' || coalesce(endpoint, 'unknown')"""

KEPT_SQL = DELIVERIES_SQL + f""",
kept as (
  select *, case when severity in ('CRITICAL', 'ERROR') then {SIGNATURE_SQL} end as signature
  from (select *, row_number() over (partition by event_id order by seq) as rn from d where kind = 'ok') where rn = 1
)"""

# Clusters (all), their first two events, and the incidents among them.
CLUSTERS_SQL = KEPT_SQL + """,
e as (select * from kept where signature is not null),
c as (
  select signature, count(*) as count, arg_min(ts, seq) as first_seen, arg_min(ts_iso, seq) as first_seen_iso,
    max(ts) as last_seen, arg_max(ts_iso, ts) as last_seen_iso, arg_min(message, seq) as sample_message,
    arg_min(severity, seq) as severity
  from e group by signature
)"""

INCIDENTS_SQL = CLUSTERS_SQL + """,
n as (select *, row_number() over (partition by signature order by seq) as pos from e),
i as (
  select substr(sha256(c.signature || '|' || c.first_seen_iso), 1, 16) as incident_id, c.signature,
    t.ts as detected_at, t.ts_iso as detected_at_iso, t.service, t.environment, t.endpoint as affected_component,
    case c.severity when 'CRITICAL' then 'critical' else 'high' end as severity, c.count, c.first_seen, c.first_seen_iso,
    c.last_seen, c.last_seen_iso, c.sample_message, c.severity as log_severity, t.seq as trigger_seq,
    t.event_id, t.message, t.error_type, t.error_message, t.stack_trace, t.request_id, t.trace_id, t.version, t.http_status,
    t.raw_ref, t.ts_iso
  from c join n t on t.signature = c.signature and t.pos = case c.severity when 'CRITICAL' then 1 else 2 end
)"""

# One planted flaw at most per row; the first that applies.
FLAWS = (
    (97, "not_json"), (73, "not_object"), (71, "trailing"), (89, "no_severity"), (83, "bad_time"),
    (79, "bad_severity"), (67, "wrong_type"), (61, "foreign"), (59, "empty_message"),
)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries as ``seq, payload, source`` with JSON text."""
    rows = deliveries(spark, sf_dir)
    number = F.col("event_id").cast("bigint")
    flaw = F.lit("none")
    for divisor, name in reversed(FLAWS):
        flaw = F.when(number % divisor == 0, name).otherwise(flaw)
    rows = with_computed(rows, flaw.alias("flaw"))
    is_flaw = lambda name: F.col("flaw") == name

    def pair(name: str, value, keep=None):
        text = F.concat(F.lit(f',"{name}":"'), value, F.lit('"'))
        return F.coalesce(F.when(keep, text) if keep is not None else text, F.lit(""))

    trace = F.replace(
        F.replace(F.col("stack_trace"), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")
    )
    stamp = F.when(is_flaw("bad_time"), "not-a-timestamp").otherwise(F.col("ts_iso"))
    body = F.concat(
        F.lit('{"timestamp":"'), stamp, F.lit('"'),
        pair("severity", F.when(is_flaw("bad_severity"), "FATAL").otherwise(F.col("severity")), ~is_flaw("no_severity")),
        F.when(is_flaw("wrong_type"), ',"service":5').otherwise(pair("service", F.col("service"))),
        pair("environment", F.col("environment")),
        pair("message", F.when(is_flaw("empty_message"), "").otherwise(F.col("message"))),
        pair("error_type", F.col("error_type")),
        pair("stack_trace", trace),
        pair("endpoint", F.col("endpoint")),
        pair("request_id", F.col("request_id")),
        pair("event_id", F.col("event_id"), number % 3 != 0),
        pair("api_key", F.lit("k-1"), number % 13 == 0),
        pair("Authorization", F.lit("Bearer b-1"), number % 13 == 0),
        F.lit(',"user":'), F.col("user_id").cast("string"), F.lit(',"code":'), F.col("k").cast("string"), F.lit("}"),
    )
    payload = (
        F.when(is_flaw("not_json"), F.concat(F.lit("not json "), F.col("event_id")))
        .when(is_flaw("not_object"), "[1, 2, 3]")
        .when(is_flaw("trailing"), F.concat(body, F.lit(" x")))
        .otherwise(body)
    )
    source = F.when(is_flaw("foreign"), "gcp").otherwise("local")
    return with_computed(rows, payload.alias("payload"), source.alias("source")).select("seq", "payload", "source")


_FLAW_SQL = "case " + " ".join(
    f"when cast(event_id as bigint) % {divisor} = 0 then '{name}'" for divisor, name in FLAWS
) + " else 'none' end"

RAW_SQL = DELIVERIES_SQL + r""",
f as (select *, """ + _FLAW_SQL + r""" as flaw, cast(event_id as bigint) as number from d),
b as (select *,
  '{"timestamp":"' || case flaw when 'bad_time' then 'not-a-timestamp' else ts_iso end || '"' ||
  case flaw when 'no_severity' then '' else ',"severity":"' || case flaw when 'bad_severity' then 'FATAL' else severity end || '"' end ||
  case flaw when 'wrong_type' then ',"service":5' else ',"service":"' || service || '"' end ||
  coalesce(',"environment":"' || environment || '"', '') ||
  ',"message":"' || case flaw when 'empty_message' then '' else message end || '"' ||
  coalesce(',"error_type":"' || error_type || '"', '') ||
  ',"stack_trace":"' || replace(replace(stack_trace, '"', '\"'), chr(10), '\n') || '"' ||
  coalesce(',"endpoint":"' || endpoint || '"', '') ||
  coalesce(',"request_id":"' || request_id || '"', '') ||
  case when number % 3 <> 0 then ',"event_id":"' || event_id || '"' else '' end ||
  case when number % 13 = 0 then ',"api_key":"k-1","Authorization":"Bearer b-1"' else '' end ||
  ',"user":' || user_id || ',"code":' || k || '}' as body from f),
raw as (select seq, case flaw when 'not_json' then 'not json ' || event_id when 'not_object' then '[1, 2, 3]'
    when 'trailing' then body || ' x' else body end as payload,
  case flaw when 'foreign' then 'gcp' else 'local' end as source from b)"""

# Status and event columns of each raw row, read from the payload text alone.
INGESTED_SQL = RAW_SQL + r""",
j as (select seq, payload, source, json_valid(payload) as is_json,
    case when json_valid(payload) then json_type(payload) end as kind_of,
    case when json_valid(payload) then cast(payload as json) end as doc from raw),
x as (select *,
    json_extract_string(doc, '$.timestamp') as f_timestamp, json_extract_string(doc, '$.severity') as f_severity,
    json_extract_string(doc, '$.service') as f_service, json_extract_string(doc, '$.message') as f_message,
    json_extract_string(doc, '$.request_id') as f_request_id, json_extract_string(doc, '$.event_id') as f_event_id,
    json_type(doc, '$.service') as t_service
  from j),
m as (select *, list_filter([case when coalesce(f_timestamp, '') = '' then 'timestamp' end,
    case when coalesce(f_severity, '') = '' then 'severity' end, case when coalesce(f_service, '') = '' then 'service' end,
    case when coalesce(f_message, '') = '' then 'message' end], lambda s: s is not null) as missing from x),
s as (select *,
  case when not is_json then 'malformed_json'
       when kind_of <> 'OBJECT' or len(missing) > 0 or f_severity not in ('CRITICAL','ERROR','WARNING','INFO','DEBUG')
            or try_cast(replace(f_timestamp, '+00:00', '') as timestamp) is null then 'invalid_schema'
       when source <> 'local' then 'unsupported_source'
       when t_service <> 'VARCHAR' then 'invalid_type' else 'ok' end as status,
  case when not is_json then 'payload is not valid JSON' when kind_of <> 'OBJECT' then 'payload is not a JSON object'
       when len(missing) > 0 then 'missing required field(s): ' || array_to_string(missing, ', ')
       when f_severity not in ('CRITICAL','ERROR','WARNING','INFO','DEBUG') then 'invalid severity: ''' || f_severity || ''''
       when try_cast(replace(f_timestamp, '+00:00', '') as timestamp) is null then 'invalid timestamp: ''' || f_timestamp || ''''
       when source <> 'local' then 'unsupported source: ' || source
       when t_service <> 'VARCHAR' then 'not a string: service' end as error
  from m),
ing as (select *, case when status = 'ok' then coalesce(nullif(f_event_id, ''), sha256(f_timestamp || '|' || f_service || '|' ||
    f_severity || '|' || f_message || '|' || coalesce(f_request_id, ''))) end as event_id from s)"""
