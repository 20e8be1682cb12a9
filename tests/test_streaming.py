"""Streams give what the batch operators give on the same input."""

import json

from pyspark.sql import functions as F

from faultline.operators.dedup import first_arrivals as batch_first_arrivals
from faultline.operators.incidents import incidents
from faultline.operators.ingest import accepted, ingest
from faultline.sources.log_lines import replay
from faultline.streaming import detect, follow
from faultline.streaming.dedup import first_arrivals, first_arrivals_event_time


def _line(n, severity="ERROR", event_id=None, endpoint="/checkout", **extra):
    return json.dumps({
        "timestamp": f"2026-08-14T16:{n // 60 % 60:02d}:{n % 60:02d}.5Z", "severity": severity, "service": "shop",
        "message": f"failed {n}", "endpoint": endpoint, "event_id": event_id or f"e{n}", **extra,
    })


def _files(folder, count=3):
    folder.mkdir()
    for part in range(count):
        lines = [_line(part * 10 + i, endpoint=f"/p{i % 4}") for i in range(10)]
        lines += [_line(500 + part, "CRITICAL", endpoint=f"/c{part}"), lines[0], "not json", "   ", ""]
        if part:
            lines.append(_line(0, event_id="e0", endpoint="/p0"))
        (folder / f"part-{part}.jsonl").write_text("\n".join(lines) + "\n")


def _run(stream, name, spark, checkpoint, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(120), query.lastProgress
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    logs, bronze = tmp_path / "logs", str(tmp_path / "bronze")
    _files(logs)
    lines = follow.follow_lines(spark, str(logs), max_files=1)
    assert follow.write_bronze_stream(lines, bronze, str(tmp_path / "c1")).awaitTermination(180)

    stored = spark.read.schema(follow.RAW_SCHEMA).parquet(f"{bronze}/load=*")
    assert stored.count() == 3 * 13 + 2
    assert stored.select("seq.batch").distinct().count() == 3
    batch_kept = batch_first_arrivals(accepted(ingest(stored)))
    expected = incidents(batch_kept)

    rows = follow.event_stream(follow.bronze_stream(spark, bronze))
    kept = first_arrivals(accepted(rows))
    found = _run(detect.incident_updates(kept), "found", spark, tmp_path / "c2")

    assert found.filter("is_new").groupBy("signature").count().filter("count > 1").isEmpty()
    latest = found.groupBy("incident_id").agg(F.max("count").alias("count"), F.max("last_seen").alias("last_seen"))
    want = expected.select("incident_id", "error_cluster.count", "error_cluster.last_seen")
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, want.collect()))
    new = found.filter("is_new").select("incident_id", "trigger_event_id", "service", "affected_component", "severity")
    trigger = expected.select("incident_id", "trigger.event_id", "service", "affected_component", "severity")
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, trigger.collect()))


def test_dedup_stream_keeps_first_and_metadata(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text("\n".join(
        [_line(1, event_id="x", note="first"), _line(2, event_id="x", note="second"), _line(3, event_id="y", note="only")]
    ))
    bronze = str(tmp_path / "bronze")
    follow.write_bronze_stream(
        follow.follow_lines(spark, str(logs)), bronze, str(tmp_path / "c1")
    ).awaitTermination(180)
    kept = first_arrivals(accepted(follow.event_stream(follow.bronze_stream(spark, bronze))))
    out = _run(
        kept.select("event_id", F.to_json("metadata").alias("md"), "ts_iso"), "kept_rows", spark, tmp_path / "c2"
    )
    rows = {r.event_id: json.loads(r.md)["note"] for r in out.collect()}
    assert rows == {"x": "first", "y": "only"}


def test_event_time_dedup(spark, tmp_path):
    folder = str(tmp_path / "events")
    spark.range(6).selectExpr(
        "cast(id % 3 as string) as event_id", "timestamp'2026-08-14 00:00:00' + make_dt_interval(0,0,0,id) as ts"
    ).write.parquet(folder)
    stream = spark.readStream.schema("event_id string, ts timestamp").parquet(folder)
    out = _run(first_arrivals_event_time(stream), "event_time", spark, tmp_path / "c")
    assert sorted(r.event_id for r in out.collect()) == ["0", "1", "2"]


def test_running_clusters_in_update_mode(spark, tmp_path):
    logs = tmp_path / "logs"
    _files(logs, 2)
    events = accepted(ingest(replay(spark, str(logs))))
    folder = str(tmp_path / "events")
    events.drop("metadata").write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    out = _run(detect.running_clusters(stream), "running", spark, tmp_path / "c", mode="update")
    from faultline.operators.clusters import clusters

    want = {r.signature: r["count"] for r in clusters(spark.read.parquet(folder)).collect()}
    got = {r.signature: r["n"] for r in out.groupBy("signature").agg(F.max("count").alias("n")).collect()}
    assert got == want
