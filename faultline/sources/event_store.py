"""Silver events at rest: one folder per day, filters reach the scan.

``write_events`` appends what ingest delivers. ``lay_out`` rewrites such a table for look-ups: rows of a day in the
order of a space-filling key of time and service, with Bloom filters on the ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "event_date"
LOOK_UP_COLUMNS = ("event_id", "request_id", "trace_id")
_KEY_BITS = 10
_PIECE = 10  # longer lists reach Parquet as bounds only


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Write events by day of their timestamp.

    Rows are dealt by day first, so a day has few files; a large day is split by size on the way.
    """
    dated = events.withColumn(DAY, F.to_date("ts"))
    dated.hint("rebalance", DAY).write.mode(mode).partitionBy(DAY).parquet(path)


def _spread(cell: Column) -> Column:
    """Bits of a number below 2**16 with a zero between each two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        cell = cell.bitwiseOR(F.shiftleft(cell, shift)).bitwiseAND(F.lit(mask))
    return cell


def layout_key(ts: Column, service: Column) -> Column:
    """Z-order of the time of day and the service's hash, ``_KEY_BITS`` bits each; null ones are in cell 0.

    Rows of one service in one stretch of the day are near each other, and so are those of either alone.
    """
    day_micros = 86_400_000_000
    cells = 1 << _KEY_BITS
    of_day = F.floor(F.pmod(F.unix_micros(ts), F.lit(day_micros)) * F.lit(cells) / F.lit(day_micros)).cast("bigint")
    of_service = F.pmod(F.xxhash64(service), F.lit(cells)).cast("bigint")
    return F.shiftleft(_spread(F.coalesce(of_day, F.lit(0).cast("bigint"))), 1).bitwiseOR(
        _spread(F.when(service.isNull(), F.lit(0).cast("bigint")).otherwise(of_service)))


def lay_out(events: DataFrame, path: str, look_up: Sequence[str] = LOOK_UP_COLUMNS, mode: str = "overwrite") -> None:
    """Rewrite stored ``events`` (a table, since the ranges are sampled in a pass of their own) for look-ups.

    Ranges of (day, key, event id) are dealt to tasks, so a service or minute with most rows is split like any other; within
    a day's files rows are sorted by the key. Row groups are told apart by the bounds of ``ts``, the dictionary of
    ``service`` and the Bloom filters of the ``look_up`` columns, sized by their distinct values.
    """
    day, key = F.to_date("ts"), layout_key(F.col("ts"), F.col("service"))
    dated = events.withColumn(DAY, day).withColumn("_layout", key)
    spread = F.xxhash64("event_id")
    dealt = dated.repartitionByRange(F.col(DAY), F.col("_layout"), spread)
    writer = dealt.sortWithinPartitions(DAY, "_layout", spread).drop("_layout").write.mode(mode).partitionBy(DAY)
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in look_up:
        if column in events.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def retrieve(
    events: DataFrame,
    services: Sequence[str] | None = None,
    severities: Sequence[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Events of the given services and severities with ``start <= ts < end``.

    On a table of ``write_events`` the range also prunes day folders; the other
    predicates are pushed to Parquet. The same call serves backfill.
    """
    out = events
    by_day = DAY in events.columns
    if start is not None:
        out = out.filter(F.col("ts") >= F.lit(start))
        if by_day:
            out = out.filter(F.col(DAY) >= F.lit(start.date()))
    if end is not None:
        out = out.filter(F.col("ts") < F.lit(end))
        if by_day:
            last = (end - timedelta(microseconds=1)).date()
            out = out.filter(F.col(DAY) <= F.lit(last))
    if services is not None:
        out = out.filter(F.col("service").isin(list(services)))
    if severities is not None:
        out = out.filter(F.col("severity").isin(list(severities)))
    return out


def look_up(events: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Events whose ``column`` is one of ``values``; none for no values, nulls among them are not matched.

    A list, however long, is a disjunction of equalities in pieces, since only those reach the Bloom filters.
    """
    asked = sorted({v for v in values if v is not None})
    if not asked:
        return events.filter(F.lit(False))
    condition = None
    for first in range(0, len(asked), _PIECE):
        piece = F.col(column).isin(asked[first:first + _PIECE])
        condition = piece if condition is None else condition | piece
    return events.filter(condition)
