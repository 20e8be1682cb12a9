"""Running values per key in arrival order, safe for a key that holds most rows.

A plain ``Window.partitionBy(key).orderBy(seq)`` sends one key to one task.
Here a key is cut into blocks of its order: each (key, block) is a window of
bounded size, block totals are pre-aggregated map-side, and a second window
over the few totals of a key gives what came before each block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 1_000_000
_BLOCK = "_block"


@dataclass(frozen=True)
class Running:
    """``kind`` is count, sum, max, min, first (of the key) or previous (row).

    ``before`` leaves the current row out of count, sum, max and min.
    """

    kind: str
    column: Column | None = None
    before: bool = False


def arrival_block(events: DataFrame, order: str = "seq", rows: int = BLOCK_ROWS) -> Column:
    """Block of an arrival order: file split of a raw ``seq``, range of a number."""
    if isinstance(events.schema[order].dataType, T.StructType):
        return F.struct(*[F.col(f"{order}.{name}") for name in ("batch", "modified", "file", "start")])
    return F.expr(f"{order} div {rows}")


def _in_block(item: Running, ordered: Window) -> Column:
    last = -1 if item.before else Window.currentRow
    upto = ordered.rowsBetween(Window.unboundedPreceding, last)
    match item.kind:
        case "count":
            return F.count(F.lit(1)).over(upto)
        case "sum":
            return F.sum(item.column).over(upto)
        case "max":
            return F.max(item.column).over(upto)
        case "min":
            return F.min(item.column).over(upto)
        case "first":
            return F.first(F.struct(item.column.alias("v"))).over(upto)
        case "previous":
            return F.lag(F.struct(item.column.alias("v"))).over(ordered)
    raise ValueError(f"unknown running kind: {item.kind}")


def _block_total(item: Running, order: Column) -> Column:
    match item.kind:
        case "count":
            return F.count(F.lit(1))
        case "sum":
            return F.sum(item.column)
        case "max":
            return F.max(item.column)
        case "min":
            return F.min(item.column)
        case "first":
            return F.min_by(F.struct(item.column.alias("v")), order)
    return F.max_by(F.struct(item.column.alias("v")), order)


def _before_block(item: Running, total: Column, before: Window) -> Column:
    match item.kind:
        case "count" | "sum":
            return F.sum(total).over(before)
        case "max":
            return F.max(total).over(before)
        case "min":
            return F.min(total).over(before)
        case "first":
            return F.first(total).over(before)
    return F.last(total).over(before)


def _combined(item: Running, before: Column, inside: Column) -> Column:
    match item.kind:
        case "count" | "sum":
            return F.when(before.isNull(), inside).when(inside.isNull(), before).otherwise(before + inside)
        case "max":
            return F.greatest(before, inside)
        case "min":
            return F.least(before, inside)
        case "first":
            return F.coalesce(before, inside)["v"]
    return F.coalesce(inside, before)["v"]


def with_running(
    rows: DataFrame,
    keys: Sequence[str],
    order: Column,
    block: Column,
    values: Mapping[str, Running],
) -> DataFrame:
    """``rows`` plus one running column per entry of ``values``.

    ``keys`` must not be NULL; ``order`` must be a total order within a key, and
    ``block`` must grow with it. ``rows`` is read twice: pass a stored table.
    """
    keys = list(keys)
    blocked = rows.withColumn(_BLOCK, block)
    ordered = Window.partitionBy(*keys, _BLOCK).orderBy(order)
    inside = blocked.select(
        "*", *[_in_block(item, ordered).alias(f"_in_{name}") for name, item in values.items()]
    )

    totals = blocked.groupBy(*keys, _BLOCK).agg(
        *[_block_total(item, order).alias(f"_total_{name}") for name, item in values.items()]
    )
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(
        *keys, _BLOCK,
        *[
            _before_block(item, F.col(f"_total_{name}"), before).alias(f"_before_{name}")
            for name, item in values.items()
        ],
    )
    joined = inside.join(earlier, [*keys, _BLOCK], "left")
    return joined.select(
        *[F.col(c) for c in rows.columns],
        *[
            _combined(item, F.col(f"_before_{name}"), F.col(f"_in_{name}")).alias(name)
            for name, item in values.items()
        ],
    )
