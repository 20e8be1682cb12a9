"""Rows taken out of a table of documents by their id and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.storage import stored

#: Lists up to this many rows are sent to every task; longer ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def text_hash() -> Column:
    return F.xxhash64("text")


def small(rows: DataFrame) -> DataFrame:
    """``rows`` (cheap to count), marked for broadcast where they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text hash stand in ``rejected(doc_id, text_hash)``.

    Ids may repeat or be null: equal ids with other texts stay. All columns of ``docs`` stay.
    """
    bad = small(stored(rejected.select("doc_id", "text_hash").distinct(), "rejected"))
    return whole_rows(docs).join(bad, same_document(bad), "left_anti").select("doc.*")


def whole_rows(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``doc``, so that no name of theirs clashes with a name that is added."""
    return docs.select(F.struct("*").alias("doc"))


def same_document(found: DataFrame) -> Column:
    """Whether a whole row has the doc_id and the text hash of a row of ``found``."""
    return F.col("doc.doc_id").eqNullSafe(found["doc_id"]) & (F.xxhash64("doc.text") == found["text_hash"])
