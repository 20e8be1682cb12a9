"""Records of a declared layout, and similar incidents against every pair by hand."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.operators.families import incident_families
from faultline.operators.ingest import ingest, parse
from faultline.sources.mappings import CLOUD_ENTRY, RecordLayout

START = datetime(2024, 1, 1)


def _ingested(spark, entries, source="cloud", **kwargs):
    rows = [(i, e if isinstance(e, str) else json.dumps(e), source) for i, e in enumerate(entries)]
    raw = spark.createDataFrame(rows, "seq long, payload string, source string")
    out = ingest(raw, layouts={"cloud": CLOUD_ENTRY}, **kwargs)
    return [r.asDict() for r in out.withColumn("metadata", F.to_json("metadata")).orderBy("seq").collect()]


def _entry(**fields):
    return {"insertId": "i-1", "timestamp": "2024-01-01T00:00:00Z", "severity": "ERROR", "textPayload": "failed",
            "resource": {"type": "run", "labels": {"service_name": "pay", "zone": "b"}}} | fields


def test_cloud_entries(spark):
    rows = _ingested(spark, [
        _entry(trace="projects/p/traces/abc", labels={"environment": "production", "zone": "a", "session_token": "x"}),
        _entry(severity="EMERGENCY", textPayload=None, jsonPayload={
            "message": "mail a@b.example", "stack_trace": "s", "event_id": "not this", "raw_ref": "nor this", "n": 1}),
        _entry(severity=None), _entry(severity="LOUD"), _entry(textPayload=5), _entry(resource={}), _entry(insertId=None),
        "[]", "no json", _entry(timestamp=None, receiveTimestamp="2024-01-02T00:00:00Z"), _entry(labels="no object"),
    ])
    assert [r["status"] for r in rows] == [
        "ok", "ok", "ok", "invalid_schema", "invalid_type", "invalid_schema", "ok", "invalid_schema", "malformed_json", "ok", "ok"]
    first, second = rows[:2]
    assert (first["event_id"], first["service"], first["environment"], first["trace_id"]) == ("i-1", "pay", "production", "abc")
    assert json.loads(first["metadata"]) == {"zone": "a"} and first["message"] == "failed"
    assert first["signature"] == "production:pay:unknown:unknown:failed:unknown"
    assert second["severity"] == "CRITICAL" and second["message"] == "mail [REDACTED]"
    assert second["raw_ref"] == second["event_id"] == "i-1" and json.loads(second["metadata"]) == {"n": 1, "zone": "b"}
    assert rows[2]["severity"] == "INFO" and len(rows[6]["event_id"]) == 64
    assert rows[9]["ts_iso"].startswith("2024-01-02") and json.loads(rows[10]["metadata"]) == {"zone": "b"}


def test_other_sources_are_quarantined_still(spark):
    local = {"timestamp": "2024-01-01T00:00:00Z", "severity": "INFO", "service": "s", "message": "m"}
    assert [r["status"] for r in _ingested(spark, [local, _entry()], "local")] == ["ok", "invalid_schema"]
    assert [r["status"] for r in _ingested(spark, [local], "elsewhere")] == ["unsupported_source"]
    assert _ingested(spark, []) == []


def test_a_layout_of_ones_own(spark):
    layout = RecordLayout(
        paths={"timestamp": ("$.t",), "severity": ("$.l",), "service": ("$.s",), "message": ("$.m", "$.alt")},
        renamed={"severity": {"warn": "WARNING"}}, metadata=("$.x",))
    payload = json.dumps({"t": "2024-01-01T00:00:00Z", "l": "warn", "s": "a", "m": None, "alt": "text", "x": {"k": [1]}})
    raw = spark.createDataFrame([(1, payload, "mine")], "seq long, payload string, source string")
    row = ingest(raw, layouts={"mine": layout}).withColumn("metadata", F.to_json("metadata")).first()
    assert (row.status, row.severity, row.message, row.metadata) == ("ok", "WARNING", "text", '{"k":[1]}')


def test_a_record_is_walked_once_for_its_fields(spark):
    raw = spark.createDataFrame([], "seq long, payload string, source string")
    plan = parse(raw, {"cloud": CLOUD_ENTRY})._jdf.queryExecution().optimizedPlan().toString()
    # one read for all paths, some for the seal of the payload and the tested texts; not two and more a path
    assert plan.count("variant_get(") < sum(map(len, CLOUD_ENTRY.paths.values()))


def test_paths_that_one_walk_cannot_hold(spark):
    layout = RecordLayout(
        paths={"timestamp": ("$.t",), "severity": ("$.l[1]",), "service": ("$.S", "$.s"), "message": ("$.x.m", "$.m"),
               "environment": ("$.m.e",), "version": ("$.y.v.w",), "request_id": ("$.y.v",)},
        metadata=("$.x", "$.y", "$.z"))
    record = {"t": "2024-01-01T00:00:00Z", "l": [0, "INFO"], "s": "a", "m": {"e": "test"},
              "x": {"m": "text", "k": 1, "service": "no"}, "y": {"k": 2, "m": 3, "v": {"w": "v1"}, "n": None}, "z": "no object"}
    raw = spark.createDataFrame([(1, json.dumps(record), "mine")], "seq long, payload string, source string")
    row = parse(raw, {"mine": layout}).select(F.to_json("document").alias("document")).first()
    assert json.loads(row.document) == {
        "timestamp": "2024-01-01T00:00:00Z", "severity": "INFO", "service": "a", "message": "text", "environment": "test",
        "version": "v1", "request_id": {"w": "v1"}, "k": 1, "m": 3, "n": None}


def test_asked_columns_are_those_of_the_whole_ingest(spark):
    names = ["signature", "raw_ref", "endpoint", "http_status", "source", "message"]
    payloads = [json.dumps({
        "timestamp": "2024-01-01T00:00:00Z", "severity": s, "service": "s", "message": "to a@b.example", "endpoint": e, "http_status": h})
        for s in ("ERROR", "INFO", "BAD") for e in ("/x", None, 5, "mail c@d.example") for h in (500, "500", None, 5.0)]
    raw = spark.createDataFrame([(i, p, "local") for i, p in enumerate(payloads)], "seq long, payload string, source string")
    whole = ingest(raw).select("seq", "payload", "status", "error", *names)
    asked = ingest(raw, columns=names)
    bare = json.dumps({"timestamp": "2024-01-01T00:00:00Z", "severity": "ERROR", "service": "s", "message": "m"})
    only = ingest(spark.createDataFrame([(1, bare, "local")], "seq long, payload string, source string")).first()
    assert (only.endpoint, only.http_status, only.signature) == (None, None, "unknown:s:unknown:unknown:m:unknown")
    assert asked.columns == whole.columns and sorted(asked.collect(), key=repr) == sorted(whole.collect(), key=repr)
    with pytest.raises(ValueError, match="no event columns"):
        ingest(raw, columns=["nothing"])


def _by_hand(rows, percent):
    words = {r[0]: set((r[4] or "").split()) for r in rows}
    out = []
    for a in rows:
        near = [b for b in rows if b[1:3] == a[1:3] and words[a[0]] and words[b[0]]
                and 100 * len(words[a[0]] & words[b[0]]) >= percent * len(words[a[0]] | words[b[0]])]
        head = min(((b[3], b[0]) for b in near), default=(a[3], a[0]))[1]
        out.append((a[0], max(len(near) - 1, 0), head))
    return sorted(out)


@pytest.mark.parametrize("percent", [30, 80, 100])
def test_families_match_every_pair_by_hand(spark, percent):
    rng = random.Random(percent)
    texts = [None, "", " \t", "common"] + [
        " ".join(["common", "words", *rng.choices("abcdefgh", k=rng.randrange(1, 9))]) for _ in range(60)]
    rows = [(f"i{n:03}", f"s{n % 2}", START + timedelta(hours=n % 3), START + timedelta(minutes=rng.randrange(5)),
             "common storm words" if n % 3 == 0 else rng.choice(texts)) for n in range(240)]
    given = spark.createDataFrame(
        rows, "incident_id string, service string, group_start timestamp, first_seen timestamp, wording string")
    got = incident_families(given.withColumn("word", F.lit(1)), percent).collect()
    assert sorted((r.incident_id, r.similar_incidents, r.head_id) for r in got) == _by_hand(rows, percent)
    assert incident_families(given.limit(0), percent).count() == 0


def test_families_take_a_percentage(spark):
    rows = spark.createDataFrame([], "incident_id string, service string, group_start timestamp, first_seen timestamp, wording string")
    with pytest.raises(ValueError, match="percent"):
        incident_families(rows, 0)
