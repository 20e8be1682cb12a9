"""Incidents on a stream: running clusters and once-only detection per signature."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from faultline.functions import keys
from faultline.streaming.dedup import arrival_order

# What detection needs of an error event, plus the rows and latest time it stands for.
INPUT_COLUMNS = (
    "signature", "seq", "event_id", "ts", "ts_iso", "severity", "service", "environment", "endpoint", "message",
)

OUTPUT_SCHEMA = (
    "signature string, is_new boolean, count bigint, first_seen timestamp, first_seen_iso string, "
    "last_seen timestamp, sample_message string, log_severity string, "
    "trigger_event_id string, detected_at timestamp, service string, environment string, affected_component string"
)

# State of a signature: the head (first event), the running values, and the
# incident's own fields once there is one.
_STATE = T.StructType([
    T.StructField("count", T.LongType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("first_seen_iso", T.StringType()),
    T.StructField("sample_message", T.StringType()),
    T.StructField("log_severity", T.StringType()),
    T.StructField("last_seen", T.TimestampType()),
    T.StructField("trigger_event_id", T.StringType()),
    T.StructField("detected_at", T.TimestampType()),
    T.StructField("service", T.StringType()),
    T.StructField("environment", T.StringType()),
    T.StructField("affected_component", T.StringType()),
])


def leading_rows(batch: pd.DataFrame) -> pd.DataFrame:
    """The first two rows of each signature; the first carries count and latest time of all."""
    if not len(batch):
        return batch
    ordered = batch.iloc[arrival_order(batch["seq"])]
    groups = ordered.groupby("signature", sort=False)
    position = groups.cumcount()
    total, latest = groups["rows"].transform("sum"), groups["latest"].transform("max")
    lead = position < 2
    return ordered[lead].assign(
        rows=total[lead].where(position[lead] == 0, 0), latest=latest[lead]
    )


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield leading_rows(batch)


def _clean(value):
    return None if value is None or value is pd.NaT or value != value else value


class _Detect(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("cluster", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        lead = None
        for batch in rows:
            if len(batch):
                lead = leading_rows(batch if lead is None else pd.concat([lead, batch]))
        if lead is None:
            return
        added, latest = int(lead["rows"].sum()), lead["latest"].max().to_pydatetime()
        names = [f.name for f in _STATE.fields]
        if self._state.exists():
            state = dict(zip(names, self._state.get()))
            state["count"] += added
            state["last_seen"] = max(pd.Timestamp(state["last_seen"]).to_pydatetime(), latest)
        else:
            head = lead.iloc[0]
            state = dict.fromkeys(names)
            state.update(
                count=added, first_seen=head["ts"].to_pydatetime(), first_seen_iso=head["ts_iso"],
                sample_message=head["message"], log_severity=head["severity"], last_seen=latest,
            )
        threshold = 1 if state["log_severity"] == "CRITICAL" else 2
        is_new = state["trigger_event_id"] is None and state["count"] >= threshold
        if is_new:
            # The threshold-th event of the signature is among the leading rows of this batch.
            trigger = lead.iloc[threshold - 1 - (state["count"] - added)]
            state.update(
                trigger_event_id=trigger["event_id"], detected_at=trigger["ts"].to_pydatetime(),
                service=trigger["service"], environment=_clean(trigger["environment"]),
                affected_component=_clean(trigger["endpoint"]),
            )
        self._state.update(tuple(state[name] for name in names))
        if state["trigger_event_id"] is not None:
            yield pd.DataFrame([{"signature": key[0], "is_new": is_new, **state}])

    def close(self) -> None:
        pass


def incident_updates(kept: DataFrame) -> DataFrame:
    """One row per incident and micro-batch that touched it, ``is_new`` exactly once.

    ``kept`` are de-duplicated events of a stream. Rows are combined per Arrow
    batch first: of each signature two leading rows and the count go on, so a
    hot signature reaches its state as a few rows per task.
    """
    errors = kept.filter(F.col("signature").isNotNull()).select(
        *INPUT_COLUMNS, F.lit(1).cast("bigint").alias("rows"), F.col("ts").alias("latest")
    )
    combined = errors.mapInPandas(_combine, errors.schema)
    found = combined.groupBy("signature").transformWithStateInPandas(
        statefulProcessor=_Detect(), outputStructType=OUTPUT_SCHEMA, outputMode="Append", timeMode="None",
    )
    return found.select(
        keys.incident_id(F.col("signature"), F.col("first_seen_iso")).alias("incident_id"),
        "*", keys.business_severity(F.col("log_severity")).alias("severity"),
    )


def running_clusters(kept: DataFrame) -> DataFrame:
    """Cluster table of a stream in update mode, by Spark's own streaming aggregate."""
    from faultline.operators.clusters import clusters

    return clusters(kept)
