"""The laid-out event table: whole rows, and look-ups that read a small share of the row groups."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.plans import incident_flow
from faultline.sources.event_store import DAY, layout_key, lay_out, look_up, read_events, retrieve, write_events

ROWS = 200_000
START = datetime(2026, 8, 14)


@pytest.fixture(scope="module")
def events(spark):
    """Two days; one service has a third of the rows; ids in no order."""
    n = F.col("id")
    return spark.range(ROWS, numPartitions=4).select(
        F.sha2(n.cast("string"), 256).alias("event_id"),
        F.timestamp_micros(F.lit(int((START - datetime(1970, 1, 1)).total_seconds()) * 1_000_000)
                           + F.pmod(F.xxhash64(n), F.lit(172_800_000_000))).alias("ts"),
        F.when(n % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("svc-"), F.pmod(F.hash(n), F.lit(40)))).alias("service"),
        F.when(n % 5 != 0, F.md5((n / 2).cast("bigint").cast("string"))).alias("request_id"),
        F.lit("ERROR").alias("severity"), n.alias("n"))


@pytest.fixture(scope="module")
def tables(spark, events, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    size, parts = "parquet.block.size", "spark.sql.shuffle.partitions"
    hadoop, before = spark._jsc.hadoopConfiguration(), spark.conf.get(parts)
    # small row groups and files, as a large table has many of them; there the ids are too many for a dictionary
    hadoop.set(size, str(64 << 10))
    plain = [f"parquet.enable.dictionary#{c}" for c in ("event_id", "request_id")]
    for name in plain:
        hadoop.set(name, "false")
    spark.conf.set(parts, "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_events(events, f"{root}/events", mode="overwrite")
        laid = incident_flow.lay_out(spark, str(root))
    finally:
        for name in (size, *plain):
            hadoop.unset(name)
        spark.conf.set(parts, before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return read_events(spark, f"{root}/events"), laid


def _scanned(rows):
    """Rows that the scan handed on, before any filter beyond the reader."""
    found = rows.collect()
    plan = rows._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    if "AdaptiveSparkPlan" in leaf.getClass().getName():
        leaf = leaf.executedPlan().collectLeaves().head()
    return found, leaf.metrics().apply("numOutputRows").value()


def test_all_rows_once(events, tables):
    columns = events.columns
    assert tables[1].select(columns).exceptAll(events).isEmpty() and events.exceptAll(tables[1].select(columns)).isEmpty()
    assert tables[1].filter(F.col(DAY) != F.to_date("ts")).isEmpty()


@pytest.mark.parametrize("column", ["request_id", "event_id"])
def test_ids_are_looked_up_in_few_row_groups(events, tables, column):
    wanted = [getattr(r, column) for r in events.filter("n in (11, 77777, 123456)").collect()]
    truth = sorted(r.n for r in events.filter(F.col(column).isin(wanted)).collect())
    plain, before = _scanned(look_up(tables[0], column, wanted))
    got, after = _scanned(look_up(tables[1], column, [*wanted, None, "no such id"]))
    assert sorted(r.n for r in plain) == sorted(r.n for r in got) == truth
    assert before > 0.9 * ROWS and after < 0.25 * ROWS


def test_a_service_and_hour_are_read_from_few_row_groups(events, tables):
    span = START + timedelta(hours=30), START + timedelta(hours=31)
    for service, share in (("svc-7", 0.02), ("hot", 0.05)):
        truth = sorted(r.n for r in retrieve(events, [service], None, *span).collect())
        got, after = _scanned(retrieve(tables[1], [service], None, *span))
        assert sorted(r.n for r in got) == truth and truth and after < share * ROWS


def test_look_up_of_many_and_none(events, tables):
    wanted = [r.event_id for r in events.filter("n < 35").collect()]
    assert sorted(r.n for r in look_up(tables[1], "event_id", wanted).collect()) == list(range(35))
    assert look_up(tables[1], "event_id", []).isEmpty() and look_up(tables[1], "event_id", [None]).isEmpty()


def test_odd_rows(spark, tmp_path):
    odd = spark.createDataFrame(
        [("a", None, None, None), ("a", None, None, None), (None, START, "s", "r"), ("b", datetime(1960, 2, 3, 23, 59, 59, 999999), "", "r")],
        "event_id string, ts timestamp, service string, request_id string")
    for rows in (odd, odd.limit(0)):
        path = str(tmp_path / str(rows.count()))
        lay_out(rows, path)
        if rows.count():
            assert sorted(map(str, read_events(spark, path).drop(DAY).collect())) == sorted(map(str, rows.collect()))


def test_key_interleaves_time_and_service(spark):
    rows = spark.range(24).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.lit("x").alias("service"))
    found = [r.k for r in rows.select("ts", layout_key(F.col("ts"), F.col("service")).alias("k")).orderBy("ts").collect()]
    assert found == sorted(found) and len(set(found)) == 24 and max(found) < 1 << 20
    service = {k & 0x55555 for k in found}
    assert len(service) == 1
