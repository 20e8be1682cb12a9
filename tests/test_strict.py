"""Wrong types at the gate and in packages, secrets in the flow, order of rotated files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from faultline.operators import gate
from faultline.operators.conformance import check_packages
from faultline.plans import incident_flow as flow
from faultline.sources.json_documents import parse_results
from faultline.sources.log_lines import replay

RESULT = {
    "incident_id": "i", "hypothesis_assessments": [{"statement": "s", "prior_confidence": 0.5, "verdict": "confirmed", "evidence": ["e"]}],
    "additional_facts": [], "validated_root_cause": "a cause", "root_cause_evidence": [], "planning_path": "lightweight",
    "planning_path_reason": "", "undetermined": [],
}
WRONG_RESULTS = [
    {"validated_root_cause": 5}, {"validated_root_cause": True}, {"validated_root_cause": {"a": 1}}, {"incident_id": 5},
    {"hypothesis_assessments": [{**RESULT["hypothesis_assessments"][0], "statement": 5}]}, {"planning_path_reason": 1},
    {"root_cause_evidence": [5]}, {"additional_facts": None}, {"hypothesis_assessments": None},
]


@pytest.mark.parametrize("change", [{}, *WRONG_RESULTS], ids=str)
def test_gate_refuses_wrong_types(spark, change):
    rows = parse_results(spark.createDataFrame([("f", json.dumps(RESULT | change))], "file string, text string"))
    got = gate.with_decision(rows).first()
    assert (len(got.violations) > 0, got.authorized) == (bool(change), not change)


PACKAGE = {
    "incident_id": "i", "schema_version": "1.1", "severity": "high", "detected_at": "2026-08-14T16:24:16Z", "service": "s", "summary": "x",
    "confidence_overall": 0.5, "observed_facts": [{"statement": "f", "evidence": [
        {"source": "log", "log_query_or_reference": "r", "timestamp": "2026-08-14T16:24:16.5Z", "count": 2}]}],
    "error_clusters": [{"signature": "a", "count": 2, "first_seen": "2026-08-14T16:24:16Z", "last_seen": "2026-08-14T16:24:16+00:00", "severity": "high"}],
    "timeline": [{"timestamp": "2026-08-14T16:24:16Z", "event": "e"}], "impact": {"value": "1.5", "metric": "m"},
    "hypotheses": [{"statement": "h", "confidence": 1, "supporting_correlations": ["c"]}],
}
CLUSTER = PACKAGE["error_clusters"][0]
WRONG_PACKAGES = [
    {"detected_at": "yesterday"}, {"error_clusters": [CLUSTER | {"signature": 5}]}, {"error_clusters": [CLUSTER | {"count": "2"}]},
    {"error_clusters": [CLUSTER | {"severity": "huge"}]}, {"observed_facts": [{"statement": "f", "evidence": "text"}]},
    {"observed_facts": [{"statement": "f", "evidence": [{"source": "log", "other": 1}]}]}, {"observed_facts": [{"statement": 5, "evidence": []}]},
    {"timeline": [{"timestamp": "2026-08-14T16:24:16Z", "event": 5}]}, {"impact": {"value": 1.5}},
    {"hypotheses": [{"statement": "h", "confidence": 1, "supporting_correlations": "c"}]}, {"timeline": [{"timestamp": "2026-13-40T99:00:00Z", "event": "e"}]},
]


def test_package_types(spark):
    rows = [(i, json.dumps(PACKAGE | change)) for i, change in enumerate([{}, *WRONG_PACKAGES])]
    got = {r.id: list(r.violations) for r in check_packages(spark.createDataFrame(rows, "id int, package string")).collect()}
    assert got[0] == [] and all(len(got[i]) == 1 for i in range(1, len(rows)))


SECRETS = ("abcdef123", "joe@example.com", "abcdef12345", "abcdefgh12345678", "n3sted", "dXNlcjpwYXNz", "qu0ted", "10.20.30.40", "4111111111111111")


def _log_line(event, second, **more):
    return json.dumps({"timestamp": f"2026-08-14T16:24:{second:02d}Z", "severity": "CRITICAL", "service": "svc", "event_id": event,
                       "message": "m"} | more)


def test_no_secret_leaves_bronze(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text(_log_line(
        "e1", 1, message='login password=abcdef123 by joe@example.com, Authorization: Basic dXNlcjpwYXNz {"password": "qu0ted"} from 10.20.30.40',
        error_message="token=abcdef12345", stack_trace="Bearer abcdefgh12345678 card 4111111111111111",
        metadata={"password": "n3sted", "note": "TOKEN=abcdef12345"}, list=["x", {"y": "joe@example.com", "z": 'my token = "abcdef12345" and secret: abcdef123'}]))
    out = str(tmp_path / "out")
    flow.ingest_files(spark, str(logs), out)
    flow.detect(spark, out)
    changes = spark.sql("select 7 as change_id, 'svc' as service, timestamp'2026-08-14 15:00:00' as ts union all select 8, 'svc', timestamp'2026-08-14 09:00:00'"
                        " union all select 9, 'svc', timestamp'2026-08-14 12:00:00'")
    sent = flow.hand_off(spark, out, changes=changes)
    events = json.loads(sent.first().payload)["incident_package"]["correlated_events"]
    assert [e["description"] for e in events] == ["change 9", "change 7"]
    for table in ("events", "clusters", "incidents", "prompts", "packages", "outbox"):
        text = " ".join(spark.read.parquet(f"{out}/{table}").select(F.to_json(F.struct("*")).alias("j")).toPandas()["j"])
        assert not [s for s in SECRETS if s in text], table
    assert "[REDACTED]" in spark.read.parquet(f"{out}/prompts").first().prompt

    incident = sent.first().incident_id
    results = tmp_path / "results"
    results.mkdir()
    (results / "good.json").write_text(json.dumps(RESULT | {"incident_id": incident}))
    (results / "bad.json").write_text(json.dumps(RESULT | {"incident_id": incident, "validated_root_cause": 5}))
    assert flow.implement(spark, out, str(results)).count() == 1


def test_rotated_files_are_read_in_the_order_written(spark, tmp_path):
    for name, when in (("app.log.10", 300), ("app.log.2", 200), ("app.log", 400), ("b.log", 100)):
        (tmp_path / name).write_text(f"{when} a\n{when} b\n")
        os.utime(tmp_path / name, (1_700_000_000 + when, 1_700_000_000 + when))
    rows = replay(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.payload for r in rows] == [f"{when} {x}" for when in (100, 200, 300, 400) for x in "ab"]
