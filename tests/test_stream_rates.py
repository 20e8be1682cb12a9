"""Rates on a stream equal those of the batch, in any order of arrival within the watermark."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from faultline.operators import anomalies
from faultline.streaming import rates

START = datetime(2026, 8, 14, tzinfo=timezone.utc)


def _events(seed):
    """40 hours of three services: quiet hours, hours without events, bursts of errors."""
    draw = random.Random(seed)
    rows = []
    for hour in range(40):
        for service in "abc":
            if draw.random() < 0.2:
                continue
            bad = draw.choice([0.05, 0.1, 0.1, 0.9])
            for _ in range(draw.randrange(1, 12)):
                at = START + timedelta(hours=hour, seconds=draw.randrange(3600))
                rows.append((service, at, "ERROR" if draw.random() < bad else draw.choice(["INFO", "INFO", "CRITICAL"]) if bad > 0.5 else "INFO"))
    return rows


def _stream(spark, tmp_path, rows, files, name, build, end=()):
    folder = tmp_path / "events"
    parts = [rows[i * len(rows) // files:(i + 1) * len(rows) // files] for i in range(files)]
    # a watermark counts from the batch after the one that moved it
    for part in [*parts, *([r] for r in end)]:
        spark.createDataFrame(part, "service string, ts timestamp, severity string").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("service string, ts timestamp, severity string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    assert query.awaitTermination(180), query.lastProgress
    return sorted(map(tuple, spark.table(name).collect()), key=repr)


@pytest.mark.parametrize(("operator", "limits", "seed"), [
    ("error_rate_spikes", {"deviations": 1.0, "baseline_windows": 6}, 1), ("severity_shift", {"min_errors": 2}, 2)])
def test_stream_equals_batch(spark, tmp_path, operator, limits, seed):
    draw = random.Random(seed)
    rows = _events(seed)
    # late by up to three hours, in order of arrival
    rows.sort(key=lambda r: r[1] + timedelta(minutes=draw.randrange(180)))
    end = [("z", START + timedelta(hours=100 + i), "INFO") for i in range(2)]
    got = _stream(spark, tmp_path, rows, 6, f"rates_{seed}", lambda s: getattr(rates, operator)(s, delay="3 hours", **limits), end)
    want = getattr(anomalies, operator)(spark.createDataFrame(rows, "service string, ts timestamp, severity string"), **limits)
    assert got == sorted(map(tuple, want.collect()), key=repr)
    assert any(r[-1] for r in got) and any(not r[-1] for r in got)


def test_late_events_are_dropped_and_open_windows_stay_back(spark, tmp_path):
    at = lambda hour, minute=0: START + timedelta(hours=hour, minutes=minute)
    # one file each; behind one another, stateful operators drop rows by the watermark of the batch before the last
    rows = [("a", at(0, 10), "ERROR"), ("a", at(5), "INFO"), ("a", at(5, 1), "INFO"), ("a", at(0, 20), "ERROR"), ("a", at(5, 30), "INFO")]
    got = _stream(spark, tmp_path, rows, 5, "rates_late", lambda s: rates.scored_windows(s, delay="1 hour"))
    assert [(r[1], r[2], r[3]) for r in got] == [(at(0).replace(tzinfo=None), 1, 1)]


def test_mean_and_spread_are_those_of_spark(spark):
    draw = random.Random(5)
    for n in (1, 2, 3, 24):
        values = [draw.randrange(8) / 7 for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
        assert rates._mean_and_spread(values) == tuple(df.selectExpr("avg(v)", "stddev_samp(v)").first())
    assert rates._mean_and_spread([]) == (None, None)
