"""Validation, identity, sanitizing, text expressions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from faultline.functions import text as tx
from faultline.functions import timestamps as tm
from faultline.operators.ingest import accepted, ingest, quarantine
from faultline.operators.stats import ingest_counters
from faultline.sources.log_lines import replay

GOOD = {"timestamp": "2026-08-14T16:24:16.729Z", "severity": "ERROR", "service": "shop", "message": "m"}


def _rows(spark, payloads, source="local"):
    return spark.createDataFrame(
        [(i, p, source) for i, p in enumerate(payloads)], "seq long, payload string, source string"
    )


def _good(**changes):
    record = {**GOOD, **changes}
    return json.dumps({k: v for k, v in record.items() if v != "<absent>"})


CORPUS = [
    ("not json at all", "malformed_json", None),
    ('{"a":1} x', "malformed_json", None),
    ('{"a":1}{"b":2}', "malformed_json", None),
    ('{"a":1}] x', "malformed_json", None),
    ('{"a":1}} x', "malformed_json", None),
    ("{'a':1}", "malformed_json", None),
    ('{"a":01}', "malformed_json", None),
    ('{"a":1,}', "malformed_json", None),
    ("[1, 2, 3]", "invalid_schema", "payload is not a JSON object"),
    ('"text"', "invalid_schema", "payload is not a JSON object"),
    ("null", "invalid_schema", "payload is not a JSON object"),
    (_good(severity="<absent>"), "invalid_schema", "missing required field(s): severity"),
    (_good(timestamp="", message=None), "invalid_schema", "missing required field(s): timestamp, message"),
    (_good(message=0), "invalid_schema", "missing required field(s): message"),
    (_good(message=0.0), "invalid_schema", "missing required field(s): message"),
    (_good(message=False), "invalid_schema", "missing required field(s): message"),
    (_good(message=[]), "invalid_schema", "missing required field(s): message"),
    (_good(message={}), "invalid_schema", "missing required field(s): message"),
    (_good(message="0"), "ok", None),
    (_good(message="false"), "ok", None),
    (_good(severity="NOT_A_LEVEL"), "invalid_schema", "invalid severity: 'NOT_A_LEVEL'"),
    (_good(severity="error"), "invalid_schema", "invalid severity: 'error'"),
    (_good(timestamp="not-a-timestamp"), "invalid_schema", "invalid timestamp: 'not-a-timestamp'"),
    *[(_good(timestamp=t), "invalid_schema", f"invalid timestamp: '{t}'")
      for t in ("2026", "2026-08", "now", "12:00", " 2026-08-14 ", "2026-02-30", "2026-08-14T25:00:00", "2026-0814")],
    *[(_good(timestamp=t), "ok", None) for t in ("2026-08-14", "20260814", "2026-08-14 10:00", "20260814T100000Z")],
    (_good(service=5), "invalid_type", "not a string: service"),
    (_good(environment=True, version=1.5), "invalid_type", "not a string: environment, version"),
    (_good(environment="5", version="[1]", request_id=None), "ok", None),
    (_good(raw_ref=7), "invalid_type", "not a string: raw_ref"),
    (_good(raw_ref=0), "ok", None),
]


def test_corpus(spark):
    out = ingest(_rows(spark, [c[0] for c in CORPUS])).orderBy("seq").collect()
    for row, (payload, status, error) in zip(out, CORPUS, strict=True):
        assert row.status == status, (payload, row.status, row.error)
        if error is not None:
            assert row.error == error


def test_foreign_source_is_quarantined(spark):
    out = ingest(_rows(spark, [_good()], "gcp"))
    assert [r.status for r in quarantine(out).collect()] == ["unsupported_source"]
    assert accepted(out).isEmpty()


def test_invalid_utf8_is_malformed(spark):
    raw = spark.sql("select 0L seq, cast(x'7b2261223a22ff227d' as string) payload, 'local' source")
    assert ingest(raw).first().status == "malformed_json"


def test_fixture_golden(spark, tmp_path):
    trace = 'Traceback:\n  File "app/main.py", line %d, in checkout\n  File "app/pricing.py", line %d, in calculate_total\n'
    base = {"service": "checkout-api", "environment": "development", "endpoint": "/checkout"}
    error = {**base, "severity": "ERROR", "message": "Unhandled exception", "error_type": "ZeroDivisionError"}
    lines = [
        {**base, "timestamp": "2026-08-14T16:24:16.729Z", "severity": "INFO", "message": "a", "request_id": "req-100"},
        {**base, "timestamp": "2026-08-14T16:24:16.731Z", "severity": "INFO", "message": "b", "request_id": "req-100"},
        {**base, "timestamp": "2026-08-14T16:24:17.001Z", "severity": "WARNING", "message": "c"},
        {**error, "timestamp": "2026-08-14T16:24:17.100Z", "request_id": "manual-trigger-1", "stack_trace": trace % (142, 14)},
        {**error, "timestamp": "2026-08-14T16:24:17.863Z", "request_id": "manual-trigger-2", "stack_trace": trace % (160, 21)},
        "not valid json", {"timestamp": "2026-08-14T16:24:18.500Z", "service": "checkout-api", "message": "no severity"},
        {**base, "timestamp": "2026-08-14T16:24:19.000Z", "severity": "INFO", "message": "d", "Authorization": "x", "api_key": "y", "user": "u"},
    ]
    path = tmp_path / "log.jsonl"
    path.write_text("\n\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n   \n")
    from faultline.plans import incident_flow as flow

    out = str(tmp_path / "out")
    flow.ingest_files(spark, str(path), out)
    found = flow.detect(spark, out)
    outbox = flow.hand_off(spark, out)
    counters = {r.counter: r.value for r in flow.summary(spark, out).collect()}
    assert counters == {
        "malformed": 1, "invalid": 1, "quarantined": 0, "duplicate": 0, "processed": 6, "clusters": 1, "incidents": 1,
    }
    incident = found.first()
    assert incident.incident_id == "810ceafedfa0e420"
    assert incident.signature == "development:checkout-api:ZeroDivisionError:calculate_total:Unhandled exception:/checkout"
    assert incident.severity == "high" and incident.error_cluster["count"] == 2
    events = spark.read.parquet(f"{out}/events")
    fourth = events.filter("request_id = 'manual-trigger-1'").first()
    assert fourth.event_id == "24853099e7e2d25998e6b552eb537dc3c0392f56965ff6ae751f64063b2b9455"
    keys = events.filter("message = 'd'").select(F.map_keys("metadata").alias("k")).first().k
    assert sorted(keys) == ["endpoint", "user"]
    package = json.loads(outbox.first().payload)["incident_package"]
    assert package["detected_at"] == "2026-08-14T16:24:17.863000Z"
    assert package["observed_facts"][0]["statement"] == (
        "ZeroDivisionError occurred 2 time(s) in service 'checkout-api' (development)"
    )
    assert package["confidence_overall"] == 0.0 and "suspected_root_cause" not in package
    from faultline.operators.conformance import check_packages

    checked = check_packages(outbox.select(F.to_json(F.try_variant_get(F.try_parse_json("payload"), "$.incident_package", "variant")).alias("package")))
    assert checked.first().violations == []


def test_identity(spark):
    payloads = [
        _good(event_id="e1"), _good(event_id=5), _good(event_id=0, insertId="i1"), _good(event_id=""),
        _good(request_id=None), _good(event_id=5.0), _good(event_id=True),
    ]
    rows = {r.seq: r for r in ingest(_rows(spark, payloads)).collect()}

    def digest(request):
        basis = "|".join([GOOD["timestamp"], "shop", "ERROR", "m", request])
        return hashlib.sha256(basis.encode()).hexdigest()

    assert [rows[i].event_id for i in range(7)] == ["e1", "5", "i1", digest(""), digest("None"), "5.0", "True"]
    assert rows[0].raw_ref == "e1"


def test_metadata(spark):
    payload = _good(
        Authorization=1, cookie=1, password=1, access_token=1, api_key=1, apiKey=1, client_secret=1, AUTHORIZATION=1,
        tokens_used=3, source="x", insertId="i", metadata={"token": 1, "b": 2}, endpoint=None, http_status=500,
    )
    row = ingest(_rows(spark, [payload]), deep=False, redacting=False).withColumn("md", F.to_json("metadata")).first()
    assert json.loads(row.md) == {
        "source": "x", "insertId": "i", "metadata": {"token": 1, "b": 2}, "endpoint": None, "http_status": 500,
    }
    assert row.signature.endswith(":None") and row.endpoint is None and row.http_status == "500"
    deep = ingest(_rows(spark, [payload])).select(F.to_json("metadata").alias("md")).first()
    assert json.loads(deep.md)["metadata"] == {"b": 2}


def test_duplicate_key_keeps_last(spark):
    payload = _good()[:-1] + ',"message":"last"}'
    assert ingest(_rows(spark, [payload])).first().message == "last"


@pytest.mark.parametrize("text, instant, iso", [
    ("2026-08-14T16:24:16.729Z", "2026-08-14 16:24:16.729", "2026-08-14T16:24:16.729000+00:00"),
    ("2026-08-14T16:24:16Z", "2026-08-14 16:24:16", "2026-08-14T16:24:16+00:00"),
    ("2026-08-14T16:24:16.1234567+05:30", "2026-08-14 10:54:16.123456", "2026-08-14T16:24:16.123456+05:30"),
    ("20260814T162416,5-0230", "2026-08-14 18:54:16.5", "2026-08-14T16:24:16.500000-02:30"),
    ("2026-08-14", "2026-08-14 00:00:00", "2026-08-14T00:00:00"),
    ("2026-08-14x16", "2026-08-14 16:00:00", "2026-08-14T16:00:00"),
])
def test_timestamps(spark, text, instant, iso):
    row = spark.createDataFrame([(text,)], "t string").select(
        tm.instant(tm.canonical_timestamp(F.col("t"))).cast("string").alias("a"),
        tm.iso_text(tm.canonical_timestamp(F.col("t"))).alias("b"),
    ).first()
    assert (row.a, row.b) == (instant, iso)


def test_text_expressions(spark):
    def one(column, value):
        return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]

    uuid = "123e4567-e89b-12d3-a456-426614174000"
    assert one(tx.message_template, f"id {uuid} for 'a 1' and \"b\n2\" took 35ms, ٣") == "id <uuid> for <str> and <str> took #ms, #"
    trace = 'File "a.py", line 3, in outer\nFile "b.py", line 4, in größe\n'
    assert one(tx.top_frame, trace) == "größe"
    assert one(tx.top_frame, "nothing") == one(tx.top_frame, "") == one(tx.top_frame, None) == "unknown"
    assert one(lambda c: tx.truncate_head(c, 3), "abcd") == "abc...[truncated]"
    assert one(lambda c: tx.truncate_tail(c, 3), "ab😀é") == "...[truncated]...\nb😀é"
    assert one(lambda c: tx.truncate_tail(c, 4), "abcd") == "abcd"
    assert one(tx.strip_space, " \x1c a  \n") == "a"
    assert one(tx.redact, "Bearer abcdefgh12345 token=abc123xyz mail a.b@c.org") == "Bearer [REDACTED] token=[REDACTED] mail [REDACTED]"


def test_line_sources_and_counters(spark, tmp_path):
    (tmp_path / "a.log").write_text(f"{_good(event_id='a')}\r\n{_good(event_id='b')}\r  \n{_good(event_id='a')}\nbad\n")
    raw = replay(spark, str(tmp_path / "a.log"))
    assert [r.payload for r in raw.orderBy("seq").collect()][-1] == "bad"
    counters = {r.counter: r.value for r in ingest_counters(ingest(raw)).collect()}
    assert counters["processed"] == 3 and counters["duplicate"] == 1 and counters["malformed"] == 1


def test_event_store_prunes(spark, tmp_path):
    from datetime import datetime

    from faultline.sources.event_store import read_events, retrieve, write_events

    events = spark.sql(
        "select timestamp'2026-08-14 00:00:00' + make_dt_interval(id) ts, 'svc' service, 'ERROR' severity, id from range(5)"
    )
    write_events(events, str(tmp_path / "e"), mode="overwrite")
    got = retrieve(read_events(spark, str(tmp_path / "e")), ["svc"], ["ERROR"], datetime(2026, 8, 15), datetime(2026, 8, 17))
    assert sorted(r.id for r in got.collect()) == [1, 2]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "PushedFilters: []" not in plan
