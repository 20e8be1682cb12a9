"""Stated query sets taken in blocks of a bounded size, and the best rows of what tasks found for them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.storage import stored

#: Tasks' lists for one query are ranked in so many groups before the groups are.
_GROUPS = 64


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` stored with ``row``, a number that is kept from then on."""
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), name)


def blocks(rows: DataFrame, weight: str, limit: int) -> Iterator[DataFrame]:
    """Runs of numbered ``rows`` whose ``weight`` adds up to about ``limit``, in the order of ``row``.

    Sums run within the parts the rows were written in, so no task holds all rows. A single row may weigh more.
    """
    part = F.shiftright("row", 33)
    cut = rows.withColumns({
        "part": part, "block": F.floor((F.sum(weight).over(Window.partitionBy(part).orderBy("row")) - 1) / limit)})
    sizes = cut.groupBy("part", "block").agg(F.sum(weight).alias("n")).orderBy("part", "block").collect()
    run, total = [], 0
    for r in sizes:
        if run and total + r["n"] > limit:
            yield _rows_of(cut, run)
            run, total = [], 0
        run.append(r)
        total += r["n"]
    if run:
        yield _rows_of(cut, run)


def _rows_of(cut: DataFrame, run: list) -> DataFrame:
    wanted = F.lit(False)
    for r in run:
        wanted = wanted | ((F.col("part") == r["part"]) & (F.col("block") == r["block"]))
    return cut.filter(wanted).orderBy("row").drop("part", "block")


def best(found: DataFrame, keys: list[str], order: list[Column], count: int) -> DataFrame:
    """The first ``count`` rows of each of ``keys`` with their ``rank``, where every task found that many.

    Tasks are ranked in groups first, so the rows that meet at last do not grow with the number of tasks.
    """
    grouped = found.withColumn("_group", F.spark_partition_id() % _GROUPS)
    first = Window.partitionBy(*keys, "_group").orderBy(*order)
    fewer = grouped.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= count).drop("_rank", "_group")
    last = Window.partitionBy(*keys).orderBy(*order)
    return fewer.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= count)
