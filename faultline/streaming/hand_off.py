"""Hand-off and workflow on a stream, through stops and crashes.

Both keep what they need in Spark's own checkpoint: keyed state is committed with the batch it belongs to, and a batch that
was cut short runs again under the same number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from faultline import fixed_values as fv


def write_outbox_stream(
    rows: DataFrame, folder: str, checkpoint: str, deliver: Callable[[DataFrame], None] | None = None
) -> StreamingQuery:
    """Send each (event_type, incident_id) of a stream of outbox rows once; the sent rows stand in ``folder``.

    Pairs that were sent are state of the stream. What a batch sends is written first, to a folder of its own, and the
    batch is recorded last. After a crash in between the batch runs again, overwrites its folder with the same pairs, and
    calls ``deliver`` with them again: a receiver beyond Spark tells a repeat by the pair, a table has none.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        if deliver is not None:
            # what is delivered is what was written
            deliver(batch.sparkSession.read.schema(batch.schema).parquet(path))

    once = rows.dropDuplicates(["event_type", "incident_id"])
    return once.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STEPS = "seq bigint, incident_id string, previous string, state string, is_legal boolean"


class _Workflow(StatefulProcessor):
    """State of an incident: its last transition. Transitions that are not newer change nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("state", T.StringType())])
        self._last = handle.getValueState("last", schema)
        self._allowed = set(fv.LIFECYCLE_STEPS)

    def _legal(self, previous: str | None, state: str) -> bool:
        if previous is None:
            return state == fv.INITIAL_STATE
        return state == fv.FAILED_STATE or (previous, state) in self._allowed

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq, previous = self._last.get() if self._last.exists() else (None, None)
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if seq is None or r.seq > seq:
                out.append((r.seq, key[0], previous, r.state, self._legal(previous, r.state)))
                seq, previous = r.seq, r.state
        if out:
            self._last.update((int(seq), previous))
            yield pd.DataFrame(out, columns=["seq", "incident_id", "previous", "state", "is_legal"])

    def close(self) -> None:
        pass


def workflow_steps(transitions: DataFrame) -> DataFrame:
    """What ``lifecycle.checked_steps`` gives, as transitions ``seq, incident_id, state`` come in.

    ``seq`` is a number that grows along a history. A transition that comes again, in the same batch or after a restart,
    is dropped, and an incident goes on from the state it had. The transitions of an incident in one batch meet in one task.
    """
    rows = transitions.select(F.col("seq").cast("bigint").alias("seq"), "incident_id", "state")
    return rows.groupBy("incident_id").transformWithStateInPandas(
        statefulProcessor=_Workflow(), outputStructType=_STEPS, outputMode="Append", timeMode="None")
