"""Bounded samples of labelled ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ids_by_class(rows: DataFrame, of: str, count: int) -> DataFrame:
    """At most ``count`` distinct ids of each value of ``of`` in ``rows(doc_id, <of>)``, with ``rank`` by a hash of the id.

    An id that stands in several classes counts in the least of them; repeated rows count once. Ids far from the
    least hashes are dropped by a threshold before ranks are taken, so that no window holds a whole class. The
    result has at most ``count`` rows a class; classes are few.
    """
    ids = rows.groupBy("doc_id").agg(F.min(of).alias(of))
    sizes = ids.groupBy(of).agg(F.count("*").alias("n"))
    drawn = ids.select("doc_id", of, F.xxhash64("doc_id", F.lit(7)).alias("draw"))
    likely = drawn.join(F.broadcast(sizes), of).filter(
        F.col("draw").cast("double") <= (F.lit(4.0 * count) / F.col("n") - 0.5) * float(2**64))
    order = Window.partitionBy(of).orderBy("draw", "doc_id")
    ranked = likely.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= count).select("doc_id", "rank")
