"""Clusters, incidents, running values, dedup, gate, outbox, lifecycle, checkout."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.operators import checkout, dedup, gate, incidents, outbox, versions
from faultline.operators.clusters import clusters
from faultline.operators.running import Running, with_running

START = datetime(2026, 8, 14)
EVENT = (
    "seq long, event_id string, ts timestamp, ts_iso string, severity string, service string, environment string, "
    "message string, error_type string, stack_trace string, endpoint string, signature string, raw_ref string"
)


def _events(spark, rows):
    """rows: (seq, signature, severity, minute)."""
    return spark.createDataFrame([
        (seq, f"e{seq}", START + timedelta(minutes=m), (START + timedelta(minutes=m)).isoformat() + "+00:00", severity,
         "svc", "prod", f"m{seq}", "E", None, "/x", signature, f"r{seq}")
        for seq, signature, severity, m in rows
    ], EVENT)


def test_cluster_follows_arrival_not_time(spark):
    events = _events(spark, [(1, "a", "ERROR", 30), (2, "a", "CRITICAL", 10), (3, "a", "ERROR", 20), (4, "b", "ERROR", 1)])
    a = clusters(events).filter("signature = 'a'").first()
    assert (a["count"], a.first_seen, a.last_seen) == (3, START + timedelta(minutes=30), START + timedelta(minutes=30))
    assert (a.sample_message, a.severity) == ("m1", "ERROR")
    assert clusters(events, by_time=True).filter("signature = 'a'").first().first_seen == START + timedelta(minutes=10)


def test_thresholds(spark):
    events = _events(spark, [
        (1, "one", "ERROR", 1), (2, "two", "ERROR", 2), (3, "two", "ERROR", 3), (4, "crit", "CRITICAL", 4),
        (5, "later", "ERROR", 5), (6, "later", "CRITICAL", 6), (7, "two", "ERROR", 9),
    ])
    rows = {r.signature: r for r in incidents.incidents(events).collect()}
    assert set(rows) == {"two", "crit", "later"}
    assert rows["crit"].severity == "critical" and rows["crit"].trigger.event_id == "e4"
    assert rows["later"].severity == "high" and rows["later"].trigger.event_id == "e6"
    assert rows["two"].error_cluster["count"] == 3
    frozen = {r.signature: r.error_cluster["count"] for r in incidents.incidents(events, as_of="trigger").collect()}
    assert frozen == {"two": 2, "crit": 1, "later": 2}
    updates = incidents.incident_updates(events).filter("signature = 'two'").orderBy("seq").collect()
    assert [(u["count"], u.is_new) for u in updates] == [(2, True), (3, False)]


def test_upsert_keeps_identity(spark):
    first = _events(spark, [(1, "a", "ERROR", 1), (2, "a", "ERROR", 2)])
    both = _events(spark, [(1, "a", "ERROR", 1), (2, "a", "ERROR", 2), (3, "a", "ERROR", 3), (4, "c", "CRITICAL", 4)])
    merged = incidents.upsert(incidents.incidents(first), incidents.incidents(both))
    rows = {r.signature: r for r in merged.collect()}
    assert rows["a"].error_cluster["count"] == 3 and rows["a"].detected_at == START + timedelta(minutes=2)
    assert set(rows) == {"a", "c"}


def test_trigger_plan_limits_groups_before_the_shuffle(spark):
    plan = incidents.triggers(_events(spark, [(1, "a", "ERROR", 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    kept = dedup.first_arrivals(_events(spark, [(1, "a", "ERROR", 1)]))
    assert kept._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


@pytest.mark.parametrize("before", [False, True])
def test_running_values_match_plain_windows(spark, before):
    rng = random.Random(4)
    data = [(i, "hot" if rng.random() < 0.6 else rng.choice("abc"), rng.choice([None, *range(50)])) for i in range(400)]
    rows = spark.createDataFrame(data, "seq long, k string, v long").repartition(7)
    got = with_running(rows, ["k"], F.col("seq"), F.expr("seq div 13"), {
        "n": Running("count", before=before), "s": Running("sum", F.col("v"), before), "hi": Running("max", F.col("v"), before),
        "lo": Running("min", F.col("v"), before), "head": Running("first", F.col("v")), "prev": Running("previous", F.col("v")),
    })
    order = Window.partitionBy("k").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = rows.select(
        "*", F.count(F.lit(1)).over(upto).alias("n"), F.sum("v").over(upto).alias("s"), F.max("v").over(upto).alias("hi"),
        F.min("v").over(upto).alias("lo"),
        F.first("v").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("head"), F.lag("v").over(order).alias("prev"),
    )
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def _ttl_by_hand(rows, ttl):
    kept, last = [], {}
    for ts, seq, key in sorted((r[2], r[0], r[1]) for r in rows):
        if key not in last or ts > last[key] + timedelta(seconds=ttl):
            last[key] = ts
            kept.append(seq)
    return sorted(kept)


def test_dedup_ttl(spark):
    rng = random.Random(1)
    rows = [
        (i, "hot" if i % 3 == 0 else f"id{rng.randrange(40)}", START + timedelta(seconds=rng.randrange(3000)))
        for i in range(300)
    ] + [(1000 + n, "golden", START + timedelta(seconds=s)) for n, s in enumerate((0, 50, 99, 101, 150, 202))]
    events = spark.createDataFrame(rows, "seq long, event_id string, ts timestamp")
    kept = dedup.first_within_ttl(events, ttl_seconds=100)
    assert sorted(r.seq for r in kept.collect()) == _ttl_by_hand(rows, 100)
    assert sorted(r.seq - 1000 for r in kept.filter("event_id = 'golden'").collect()) == [0, 3, 5]


def test_dedup_ttl_of_an_id_with_many_kept_rows(spark):
    # dense: no span of the clock is empty, so the id is one piece; sparse: every kept row is a piece
    dense = spark.range(200_000).selectExpr("id as seq", "'dense' as event_id", "timestamp_seconds(id * 26) as ts")
    sparse = spark.range(50_000).selectExpr("1000000 + id as seq", "'sparse' as event_id", "timestamp_seconds(id * 500) as ts")
    kept = dedup.first_within_ttl(dense.union(sparse), ttl_seconds=100).groupBy("event_id").agg(F.count("*").alias("n"), F.sum("seq").alias("s"))
    got = {r.event_id: (r.n, r.s) for r in kept.collect()}
    assert got == {"dense": (50_000, sum(range(0, 200_000, 4))), "sparse": (50_000, sum(range(1_000_000, 1_050_000)))}


@pytest.mark.parametrize("spans", [1, 2, 7, 64])
@pytest.mark.parametrize("ttl", [1, 10, 100])
def test_dedup_ttl_in_blocks(spark, spans, ttl):
    """One id with all rows, across more blocks and batches than one task sees."""
    rng = random.Random(spans * 100 + ttl)
    rows = [(i, rng.choice(["hot"] * 9 + ["a", "b"]), START + timedelta(seconds=rng.randrange(-2500, 2500))) for i in range(4000)]
    events = spark.createDataFrame(rows, "seq long, event_id string, ts timestamp")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        kept = dedup.first_within_ttl(events, ttl, block_spans=spans)
        assert sorted(r.seq for r in kept.collect()) == _ttl_by_hand(rows, ttl)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_dedup_ttl_of_one_id_goes_to_many_tasks(spark):
    n = 400_000
    events = spark.range(n).selectExpr("id as seq", "'one' as event_id", "timestamp_micros(id * 300000 + (id * 7919) % 300000) as ts")
    kept = dedup.first_within_ttl(events, ttl_seconds=60)
    times = [i * 300_000 + (i * 7919) % 300_000 for i in range(n)]
    want, last = [], None
    for i, at in enumerate(times):
        if last is None or at > last + 60_000_000:
            want.append(i)
            last = at
    assert sorted(r.seq for r in kept.collect()) == want
    # a block's function has the times of one TTL at most, and the blocks of the id are dealt apart
    points = events.select("event_id", F.unix_micros("ts").alias("at"), F.expr(f"unix_micros(ts) div {60_000_000 * 64}").alias("block"))
    dealt = points.repartition("event_id", "block").sortWithinPartitions("event_id", "block", "at")
    steps = dealt.mapInArrow(dedup._block_steps(60_000_000, 60_000_000 * 64), dedup._STEPS).groupBy("block").count().collect()
    assert len(steps) == -(-n * 3 // 10 // (60 * 64)) and max(r["count"] for r in steps) <= 60 / 0.3 + 2
    assert dealt.select(F.spark_partition_id()).distinct().count() > 1


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(i, f"s{rng.randrange(9)}", rng.choice(["ERROR", "CRITICAL"]), rng.randrange(500)) for i in range(300)]
    seen = set()
    for partitions, seed in ((1, 3), (16, 5)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        random.Random(seed).shuffle(rows)
        found = incidents.incidents(_events(spark, rows).repartition(partitions))
        seen.add(tuple(sorted(r.incident_id + str(r.error_cluster) for r in found.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1


def _result(spark, verdicts=("confirmed",), cause="c", path="lightweight", confidence=0.5):
    row = ("i", [("h", confidence, v, []) for v in verdicts], [], cause, [], path, "", [])
    return spark.createDataFrame([row], gate.result_schema())


@pytest.mark.parametrize("changes, reason", [
    ({}, fv.REASON_AUTHORIZED), ({"path": "openspec"}, fv.REASON_AUTHORIZED),
    ({"verdicts": ("refuted", "partially_confirmed")}, fv.REASON_AUTHORIZED),
    ({"verdicts": ("refuted",)}, fv.REASON_NO_VERDICT), ({"verdicts": ("inconclusive",)}, fv.REASON_NO_VERDICT),
    ({"verdicts": ()}, fv.REASON_NO_VERDICT), ({"verdicts": (None,)}, fv.REASON_NO_VERDICT),
    ({"cause": None}, fv.REASON_NO_CAUSE), ({"cause": "  \n"}, fv.REASON_NO_CAUSE),
    ({"path": "undetermined"}, fv.REASON_UNDETERMINED), ({"verdicts": ("refuted",), "confidence": 1.0}, fv.REASON_NO_VERDICT),
])
def test_gate(spark, changes, reason):
    row = gate.with_decision(_result(spark, **changes)).first()
    assert (row.reason, row.authorized) == (reason, reason == fv.REASON_AUTHORIZED)


def test_attempts(spark):
    rows = [
        ("t", "ok", 1, 503), ("t", "ok", 2, 204), ("t", "final", 1, 401), ("t", "due", 1, 503), ("t", "net", 1, None),
        ("t", "net", 2, None), ("t", "out", 1, 500), ("t", "out", 2, 500), ("t", "out", 3, 500),
    ]
    log = spark.createDataFrame([(*r, START) for r in rows], "event_type string, incident_id string, attempt int, status_code int, attempted_at timestamp")
    got = {r.incident_id: (r.state, r.next_attempt_at) for r in outbox.attempt_state(log).collect()}
    assert got == {
        "ok": ("delivered", None), "final": ("final_failure", None), "due": ("retry_due", START + timedelta(seconds=1)),
        "net": ("retry_due", START + timedelta(seconds=2)), "out": ("final_failure", None),
    }


def test_documents(spark, tmp_path):
    from faultline.sources.json_documents import read_packages, read_results

    package = {
        "incident_id": "abc", "schema_version": "1.1", "severity": "high", "detected_at": "2026-08-14T00:00:00Z",
        "service": "s", "summary": "x", "observed_facts": [], "confidence_overall": 0.5,
    }
    (tmp_path / "p").mkdir(), (tmp_path / "r").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps(package, indent=1))
    (tmp_path / "p" / "b.json").write_text(json.dumps({**package, "incident_id": "bad", "severity": "huge", "extra": 1, "impact": {"x": 1}}))
    (tmp_path / "r" / "a.json").write_text(json.dumps({
        "incident_id": "abc", "planning_path": "openspec", "validated_root_cause": "c",
        "hypothesis_assessments": [{"statement": "h", "prior_confidence": 0.4, "verdict": "confirmed"}],
    }))
    (tmp_path / "r" / "b.json").write_text('{"incident_id": "x", "planning_path": "maybe"}')
    found = {r.incident_id: r.violations for r in read_packages(spark, str(tmp_path / "p")).collect()}
    assert found == {"abc": [], "bad": ["wrong object: impact", "not in scale: severity", "unknown: extra"]}
    results = read_results(spark, str(tmp_path / "r"))
    rows = {r.incident_id: r for r in results.collect()}
    assert rows["abc"].violations == [] and rows["abc"].undetermined == []
    assert rows["x"].violations == ["not in domain: planning_path"]
    assert gate.with_decision(results).filter("authorized").count() == 1


def test_checkout_cases(spark):
    catalog = spark.createDataFrame(
        [("prod-001", 19.99, 50), ("prod-003", 24.99, 5), ("prod-004", 49.99, 20)], "product_id string, unit_price double, stock int"
    )
    cases = [("u", "prod-009", 1, 404), ("u", "prod-003", 999, 409), ("u", "prod-003", 0, 422), ("", "prod-003", 1, 422),
             ("u", "prod-003", 5, 500), ("u", "prod-004", 3, 200), ("u", "prod-001", 50, 200)]
    requests = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "seq long, user_id string, product_id string, quantity int")
    rows = checkout.outcomes(requests, catalog).orderBy("seq").collect()
    assert [r.status for r in rows] == [c[3] for c in cases]
    assert round(rows[5].total_price, 2) == round(49.99 * 3 * (1 - 0.05 / 17), 2)
    assert round(rows[6].total_price, 2) == 899.55


def test_ledger_against_brute_force(spark):
    rng = random.Random(9)
    stock = {"hot": 40, "b": 7, "c": 12, "d": 1}
    orders = [(i, "u", "hot" if rng.random() < 0.6 else rng.choice("bcdx"), rng.randrange(0, 15)) for i in range(500)]
    left, want = dict(stock), {}
    for seq, _, product, quantity in orders:
        if quantity <= 0:
            want[seq] = 422
        elif product not in left:
            want[seq] = 404
        elif left[product] < quantity:
            want[seq] = 409
        elif quantity < 10 and left[product] == quantity:
            want[seq] = 500
        else:
            want[seq] = 200
            left[product] -= quantity
    requests = spark.createDataFrame(orders, "seq long, user_id string, product_id string, quantity int").repartition(5)
    catalog = spark.createDataFrame([(p, 2.0, s) for p, s in stock.items()], "product_id string, unit_price double, stock int")
    got = {r.seq: r.status for r in checkout.ledger(requests, catalog, spread=3).collect()}
    assert got == want


def test_analysis_provider_and_quarantine(spark):
    from faultline.operators.analysis import parse_responses, responses_from, valid_analyses

    def infer(batches):
        for batch in batches:
            yield batch.assign(response=[
                '{"summary":"s","impact_description":"i","symptoms":[],"observed_facts":[],"hypotheses":'
                '[{"statement":"a","confidence":%s}],"recommended_investigation":[]}' % p for p in batch["prompt"]
            ])[["incident_id", "response"]]

    prompts = spark.createDataFrame([("x", "0.5"), ("y", "7"), ("z", '"0.5"')], "incident_id string, prompt string")
    rows = valid_analyses(parse_responses(responses_from(prompts, infer))).collect()
    assert [(r.incident_id, r.hypotheses[0].confidence) for r in rows] == [("x", 0.5)]


def test_ledger_of_a_large_stock(spark):
    requests = spark.range(6000).selectExpr("id as seq", "'u' as user_id", "'p' as product_id", "1 + cast(id % 3 as int) as quantity")
    catalog = spark.sql("select 'p' as product_id, 10.0D as unit_price, 5000 as stock")
    left, want = 5000, {}
    for i in range(6000):
        quantity = 1 + i % 3
        want[i] = 200 if left > quantity else 500 if left == quantity else 409
        left -= quantity if left > quantity else 0
    assert {r.seq: r.status for r in checkout.ledger(requests, catalog).collect()} == want


def _ledger_by_hand(orders, stock):
    left, want = dict(stock), {}
    for seq, product, quantity in sorted(orders):
        if left[product] < quantity:
            want[seq] = 409
        elif quantity < 10 and left[product] == quantity:
            want[seq] = 500
        else:
            want[seq] = 200
            left[product] -= quantity
    return want


@pytest.mark.parametrize("block", [1, 10, 1000])
def test_ledger_in_blocks(spark, block):
    """Refusals early and late, quantities near and above the stock, in blocks from one order to all of them."""
    rng = random.Random(block)
    stock = {"a": 3000, "b": 90, "c": 17, "d": 0, "e": 9, "f": 10}
    orders = [(i, rng.choice("aaaabcdef"), rng.choice([1, 2, 3, 9, 10, 11, 17, 40, 700, 5000])) for i in range(900)]
    requests = spark.createDataFrame([(s, "u", p, q) for s, p, q in orders], "seq long, user_id string, product_id string, quantity int").repartition(3)
    catalog = spark.createDataFrame([(p, 2.0, s) for p, s in stock.items()], "product_id string, unit_price double, stock int")
    got = checkout.ledger(requests, catalog, spread=3, block=F.expr(f"seq div {block}")).collect()
    assert {r.seq: r.status for r in got} == _ledger_by_hand(orders, stock)


def test_ledger_joins_only_orders_within_the_stock(spark):
    orders = [(i, "p", 1 + i * 5 % 40) for i in range(200)]
    requests = spark.createDataFrame([(i, "u", p, q) for i, p, q in orders], "seq long, user_id string, product_id string, quantity int")
    catalog = spark.createDataFrame([("p", 1.0, 9)], "product_id string, unit_price double, stock int")
    out = checkout.ledger(requests, catalog)
    assert {r.seq: r.status for r in out.collect()} == _ledger_by_hand(orders, {"p": 9})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # two joins of orders and one of the catalog: its join with the orders was stored, those beyond the stock have none
    assert plan.count("Join ") == 3 and plan.startswith("Union")


def test_ledger_of_one_product_with_most_orders(spark):
    """Stock above a million: nearly all orders are settled by running sums, and few reach the greedy pass."""
    n, stock = 300_000, 1_200_000
    requests = spark.range(n).selectExpr("id as seq", "'u' as user_id", "'p' as product_id", "1 + cast((id * 7919) % 13 as int) as quantity")
    catalog = spark.sql(f"select 'p' as product_id, 10.0D as unit_price, {stock} as stock")
    block = F.expr("seq div 20000")
    want = _ledger_by_hand([(i, "p", 1 + i * 7919 % 13) for i in range(n)], {"p": stock})
    assert {r.seq: r.status for r in checkout.ledger(requests, catalog, block=block).select("seq", "status").collect()} == want
    ran = checkout._unbroken(requests.join(catalog, "product_id"), block)
    assert "partial_sum(quantity" in ran._jdf.queryExecution().executedPlan().toString()
    refused = ran.filter(~checkout._fits(F.col("quantity"), F.col("stock") - F.col("before")))
    assert refused.filter(F.col("quantity") <= 13).count() > 80_000
    later = checkout._candidates(refused.withColumn("stock", F.lit(13)), checkout.SPREAD)
    assert later.count() <= checkout.SPREAD * sum(13 // q for q in range(1, 14))


def _log(rows):
    """Events ``(seq, signature, minute, severity)`` with the columns that incidents carry."""
    at = lambda m: START + timedelta(minutes=m)
    return [(s, f"e{s}", sig, at(m), at(m).isoformat(), sev, "shop", "prod", "/pay", f"message {s}") for s, sig, m, sev in rows]


_LOG = ("seq long, event_id string, signature string, ts timestamp, ts_iso string, severity string, service string, "
        "environment string, endpoint string, message string")


def test_versions_of_incidents(spark):
    rng = random.Random(6)
    rows = [(0, "once", 5, "ERROR"), (1, "now", 7, "CRITICAL"), (2, "late", 50, "ERROR"), (3, "late", 20, "ERROR"), (4, "late", 30, "ERROR"), (5, "late", 60, "INFO")]
    rows += [(10 + i, rng.choice(["hot", "hot", "hot", "b", "c"]), i // 3 + rng.randrange(-4, 5), rng.choice(["ERROR", "CRITICAL"])) for i in range(300)]
    events = spark.createDataFrame(_log(rows), _LOG).repartition(3)
    history = versions.history(events)
    got = {(r.incident_id, r.version): r for r in history.collect()}
    assert len(got) == history.count()

    now = {r.incident_id: r.error_cluster for r in incidents.incidents(events).collect()}
    then = {r.incident_id: r.error_cluster for r in incidents.incidents(events, as_of="trigger").collect()}
    last = {i: max(v for j, v in got if j == i) for i in now}
    assert set(last) == {i for i, _ in got} == set(now)
    for i, cluster in now.items():
        newest, first = got[i, last[i]], got[i, 1]
        assert newest.valid_to is None and (newest["count"], newest.last_seen) == (cluster["count"], cluster.last_seen)
        assert (first["count"], first.last_seen) == (then[i]["count"], then[i].last_seen)
        assert all(got[i, v].valid_to == got[i, v + 1].valid_from >= got[i, v].valid_from for v in range(1, last[i]))

    # at any time, what the events up to the last one not later than it give
    for minute in (-10, 6, 7, 20, 33, 49, 50, 70, 1000):
        moment = START + timedelta(minutes=minute)
        seen = {r.incident_id: (r["count"], r.version) for r in versions.as_of(history, F.lit(moment)).collect()}
        want = {}
        for name in {r[1] for r in rows}:
            known, latest = 0, START - timedelta(days=9)
            own = sorted(r for r in rows if r[1] == name and r[3] != "INFO")
            need = 1 if own[0][3] == "CRITICAL" else 2
            for n, r in enumerate(own, 1):
                latest = max(latest, START + timedelta(minutes=r[2]))
                known = n if latest <= moment else known
            if known >= need:
                want[name] = (known, known - need + 1)
        assert sorted(seen.values()) == sorted(want.values())

    asked = versions.incidents_of(events, versions.as_of(history, F.lit(START + timedelta(minutes=33))))
    assert asked.columns == [*incidents.incidents(events).columns, "version"]
    for r in asked.collect():
        assert r.error_cluster["count"] == got[r.incident_id, r.version]["count"] and r.error_cluster.signature == now[r.incident_id].signature
    plan = versions.as_of(history, F.lit(START))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
