"""Columns that are computed once, whatever is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(rows: DataFrame, *columns: Column) -> DataFrame:
    """``rows`` plus aliased ``columns``, as the output of a generator.

    Filters and projections are not merged through a generator, so costly
    expressions (JSON parsing, regular expressions) are neither copied into
    every later use nor evaluated again by a filter pushed below them.
    """
    staged = rows.withColumn("_computed", F.struct(*columns))
    return staged.select(*rows.columns, F.inline(F.array("_computed")))
