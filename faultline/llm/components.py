"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from faultline.llm.selection import small
from faultline.llm.storage import stored


def _stored_with(rows: DataFrame, name: str, count: Column) -> tuple[DataFrame, int]:
    """``rows`` stored, and a count taken while they were written."""
    seen = Observation()
    done = stored(rows.observe(seen, F.coalesce(count, F.lit(0)).alias("n")), name)
    return done, int(seen.get.get("n") or 0)


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of long ids to ``(node, label)``: every linked node with the least id it reaches.

    First each node keeps its least neighbour below and hands the others on to that one, until it has
    one; then ways to the least node are halved, round by round. A round is one shuffle by the higher id of a link,
    which no common node gathers at, and is written to the shared folder. Links from a node to itself and
    repeated links are ignored; nodes without a link to another are not returned.
    """
    below = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = F.min("b").over(Window.partitionBy("a"))
    moved = 1
    while moved:
        once = below.repartition("a").dropDuplicates(["a", "b"]).withColumn("m", least)
        handed = once.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"),
                             (F.col("b") != F.col("m")).cast("long").alias("moved"))
        below, moved = _stored_with(handed, "links", F.sum("moved"))
        below = below.drop("moved")
    moved = 1
    while moved:
        above = small(below.select(F.col("a").alias("b"), F.col("b").alias("c")))
        jumped = below.join(above, "b", "left").select(
            "a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().cast("long").alias("moved"))
        below, moved = _stored_with(jumped, "links", F.sum("moved"))
        below = below.drop("moved")
    roots = below.select(F.col("b").alias("node")).distinct()
    return stored(below.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        roots.select("node", F.col("node").alias("label"))), "components")
