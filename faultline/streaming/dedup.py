"""First arrivals on a stream.

``first_arrivals`` forgets an id a fixed time after it was accepted, on the
processing clock, and drops no late rows. ``first_arrivals_event_time`` is
Spark's own operator on the event clock, which does drop rows behind the
watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline import fixed_values as fv


def order_key(value: Any) -> Any:
    """A sortable form of a ``seq`` as pandas holds it (number, row or dict)."""
    if isinstance(value, dict):
        return tuple(value.values())
    return tuple(value) if isinstance(value, (tuple, list)) else value


def arrival_order(seq: pd.Series) -> np.ndarray:
    """Places of a batch's rows in arrival order, by whole columns."""
    if seq.dtype != object:
        return seq.to_numpy().argsort(kind="stable")
    fields = pd.DataFrame(seq.tolist())
    return np.lexsort([fields[name].to_numpy() if fields[name].dtype != object else pd.factorize(fields[name], sort=True)[0]
                       for name in reversed(fields.columns)])


def first_rows(batch: pd.DataFrame, key: str) -> pd.DataFrame:
    """The earliest row of each key in one Arrow batch."""
    return batch.iloc[arrival_order(batch["seq"])].drop_duplicates(key) if len(batch) else batch


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield first_rows(batch, "event_id")


class _KeepFirst(StatefulProcessor):
    """Emits the first row of an id unless it was accepted within the TTL."""

    def __init__(self, ttl_ms: int) -> None:
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("accepted", T.BooleanType())])
        self._accepted = handle.getValueState("accepted", schema, self._ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = None
        for batch in rows:
            first = first_rows(batch, "event_id")
            if len(first) and (best is None or order_key(first["seq"].iloc[0]) < order_key(best["seq"].iloc[0])):
                best = first
        if best is not None and not self._accepted.exists():
            # Written on acceptance only, so a repeat does not extend the time.
            self._accepted.update((True,))
            yield best

    def close(self) -> None:
        pass


def first_arrivals(events: DataFrame, ttl_seconds: int = fv.DEDUP_TTL_SECONDS) -> DataFrame:
    """First arrival of each ``event_id``; columns as in ``events``.

    A micro-batch has one clock reading, so of the copies inside it only the
    first can count: they are combined per Arrow batch before the shuffle, and
    a redelivery storm of one id reaches its state as a few rows. Metadata
    travels as JSON text.
    """
    has_metadata = "metadata" in events.columns
    rows = events.withColumn("metadata", F.to_json("metadata")) if has_metadata else events
    combined = rows.mapInPandas(_combine, rows.schema)
    kept = combined.groupBy("event_id").transformWithStateInPandas(
        statefulProcessor=_KeepFirst(ttl_seconds * 1000), outputStructType=rows.schema,
        outputMode="Append", timeMode="ProcessingTime",
    )
    if not has_metadata:
        return kept
    fields = F.try_parse_json("metadata").try_cast("map<string,variant>")
    return kept.withColumn("metadata", fields)


def first_arrivals_event_time(events: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """One row per ``event_id`` within ``ttl`` of event time, late rows dropped."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["event_id"])
