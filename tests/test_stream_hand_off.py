"""Outbox and workflow streams through stops, crashes and repeats."""

import random

import pytest

from faultline import fixed_values as fv
from faultline.operators import lifecycle
from faultline.streaming import hand_off

OUTBOX = "event_type string, incident_id string, payload string"
STEPS = "seq long, incident_id string, state string"


def _put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def _outbox(spark, tmp_path, deliver=None):
    rows = spark.readStream.schema(OUTBOX).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    return hand_off.write_outbox_stream(rows, str(tmp_path / "sent"), str(tmp_path / "checkpoint"), deliver)


def test_every_pair_is_sent_once_whatever_fails(spark, tmp_path):
    draw = random.Random(2)
    pairs = [(draw.choice(["a", "b"]), f"i{draw.randrange(12)}") for _ in range(60)]
    calls, seen = [], []

    def deliver(sent):
        calls.append(1)
        got = [tuple(r)[:2] for r in sent.collect()]
        if len(calls) in (1, 3, 4):  # before anything is sent, and twice in a row
            raise RuntimeError("lost")
        seen.append(got)
        if len(calls) == 6:  # after it is sent, before the batch is recorded
            raise RuntimeError("lost")

    for i in range(4):
        _put(spark, tmp_path / "rows", [(t, x, f"p{n}") for n, (t, x) in enumerate(pairs[i * 15:(i + 1) * 15])], OUTBOX)
    crashes = 0
    for _ in range(12):
        try:
            if _outbox(spark, tmp_path, deliver).awaitTermination(120):
                break
        except Exception:
            crashes += 1
    assert crashes == 4
    sent = [(r.event_type, r.incident_id) for r in spark.read.schema(OUTBOX).parquet(f"{tmp_path}/sent/batch=*").collect()]
    assert sorted(sent) == sorted(set(pairs))
    # the receiver got the batch of the last crash twice, as the same pairs
    assert {p for got in seen for p in got} == set(pairs) and len(seen) == len({tuple(sorted(got)) for got in seen}) + 1
    _put(spark, tmp_path / "rows", [(t, x, "again") for t, x in pairs] + [("a", "new", "p")], OUTBOX)
    assert _outbox(spark, tmp_path).awaitTermination(120)
    assert spark.read.schema(OUTBOX).parquet(f"{tmp_path}/sent/batch=*").count() == len(set(pairs)) + 1


@pytest.mark.parametrize("cuts", [1, 4])
def test_workflow_goes_on_after_restarts(spark, tmp_path, cuts):
    draw = random.Random(cuts)
    states = sorted({s for pair in fv.LIFECYCLE_STEPS for s in pair} | {fv.INITIAL_STATE, fv.FAILED_STATE})
    rows = []
    for i in range(20):
        state = fv.INITIAL_STATE if draw.random() < 0.8 else draw.choice(states)
        for _ in range(draw.randrange(1, 9)):
            rows.append((len(rows), f"i{i}", state))
            following = [b for a, b in fv.LIFECYCLE_STEPS if a == state]
            state = draw.choice(following) if following and draw.random() < 0.8 else draw.choice(states)
    draw.shuffle(rows)
    rows.sort(key=lambda r: r[0] // 40)
    folder, got = tmp_path / "rows", []
    for i in range(cuts):
        part = rows[i * len(rows) // cuts:(i + 1) * len(rows) // cuts] if cuts == 1 else [r for r in rows if r[0] * cuts // len(rows) == i]
        _put(spark, folder, part + part[:7], STEPS)  # some twice
        if i:
            _put(spark, folder, rows[:5] if rows[0][0] < part[0][0] else part[:1], STEPS)  # some from long ago
        stream = hand_off.workflow_steps(spark.readStream.schema(STEPS).parquet(str(folder)))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("seq", "incident_id", "previous", "state", "is_legal")
    want = lifecycle.checked_steps(spark.createDataFrame(rows, STEPS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
