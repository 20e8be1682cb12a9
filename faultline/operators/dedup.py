"""De-duplication by event identity, first arrival wins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import fixed_values as fv
from faultline.operators.ingest import DUPLICATE, OK


def first_arrivals(events: DataFrame) -> DataFrame:
    """The earliest row of each ``event_id``.

    Planned as WindowGroupLimit before and after the shuffle: a task sends at
    most one row per id, however often the id was redelivered.
    """
    by_arrival = Window.partitionBy("event_id").orderBy("seq")
    return (
        events.withColumn("_rank", F.row_number().over(by_arrival))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def with_duplicates_marked(ingested: DataFrame) -> DataFrame:
    """Disposition of every input row: later arrivals of an id become ``duplicate``.

    First arrivals are found by a partial aggregate and joined back on ``seq``,
    which is unique, so an id that holds most rows does not gather in one task.
    """
    firsts = (
        ingested.filter(F.col("status") == OK)
        .groupBy("event_id").agg(F.min("seq").alias("seq"))
        .select("seq", F.lit(True).alias("_first"))
    )
    repeated = (F.col("status") == OK) & F.col("_first").isNull()
    return (
        ingested.join(firsts, "seq", "left")
        .withColumn("status", F.when(repeated, DUPLICATE).otherwise(F.col("status")))
        .drop("_first")
    )


#: Spans of the TTL in a block of an id.
BLOCK_SPANS = 64
_BEFORE_ALL = -(2**63)


def _groups(batch: pa.RecordBatch, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal ``keys`` begin and end in a sorted batch."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for name in keys:
        column = batch.column(name)
        new[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)))
    begin = np.flatnonzero(new)
    return begin, np.append(begin[1:], batch.num_rows)


class _Chains:
    """The rows kept in a block as a function of the last time kept before it, built from its times in order.

    A step is a time that may be the first kept one, with the last time kept if it is. Only the times of the block's
    first span can be first, and the one after them. Steps that have come to the same time are one from then on.
    """

    def __init__(self, begin: int, ttl: int) -> None:
        self.first_span, self.ttl = begin + ttl, ttl
        self.keys, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.next, self.closed = 0, False

    def add(self, at: np.ndarray) -> None:
        if not self.closed:
            inside = int(np.searchsorted(at, self.first_span))
            self.closed = inside < len(at)
            some = at[:inside + 1]
            self.keys, self.last = np.concatenate([self.keys, some]), np.concatenate([self.last, some])
        # the steps from ``next`` on, then those before it, stand in the order of their last times
        limit = int(at[-1]) - self.ttl
        while True:
            upto = self.next + int(np.searchsorted(self.last[self.next:], limit))
            moved = self.last[self.next:upto]
            self.last[self.next:upto] = at[np.searchsorted(at, moved + self.ttl, "right")] if len(moved) else moved
            if upto < len(self.last) or not len(moved):
                self.next = upto
                return
            self._merge()

    def _merge(self) -> None:
        stay = np.append(self.last[1:] != self.last[:-1], True)[:len(self.last)]
        self.keys, self.last, self.next = self.keys[stay], self.last[stay], 0

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        return self.keys, self.last


_STEPS = "event_id string, block bigint, first bigint, last bigint"


def _block_steps(ttl: int, width: int):
    """Steps of each block, from rows ``event_id, block, at`` sorted by all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, chains = None, None

        def close() -> Iterator[pa.RecordBatch]:
            if chains is not None:
                first, last = chains.steps()
                yield pa.RecordBatch.from_pydict({
                    "event_id": pa.array([open_key[0]] * len(first), pa.string()), "block": pa.array([open_key[1]] * len(first), pa.int64()),
                    "first": pa.array(first), "last": pa.array(last)})

        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("at").to_numpy(zero_copy_only=False)
            begin, end = _groups(batch, ("event_id", "block"))
            # a block that lies within the batch and one TTL is its own steps
            plain = at[end - 1] - at[begin] <= ttl
            plain[-1] = False
            plain[0] &= open_key != (batch.column("event_id")[0].as_py(), batch.column("block")[0].as_py())
            rows = np.flatnonzero(np.repeat(plain, end - begin))
            if len(rows):
                some = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([some.column(c) for c in ("event_id", "block", "at", "at")], ["event_id", "block", "first", "last"])
            for b, e in zip(begin[~plain].tolist(), end[~plain].tolist(), strict=True):
                key = (batch.column("event_id")[b].as_py(), batch.column("block")[b].as_py())
                if key != open_key:
                    yield from close()
                    open_key, chains = key, _Chains(key[1] * width, ttl)
                chains.add(at[b:e])
        yield from close()

    return run


def _block_entries(ttl: int):
    """Last time kept before each block but an id's first, from steps sorted by ``event_id, block, first``.

    One value is carried from block to block, also from batch to batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block, last, found = None, None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, blocks, entries = [], [], []
            first, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
            begin, end = _groups(batch, ("event_id", "block"))
            names = batch.column("event_id").take(pa.array(begin)).to_pylist()
            numbers = batch.column("block").take(pa.array(begin)).to_pylist()
            for b, e, of, number in zip(begin.tolist(), end.tolist(), names, numbers, strict=True):
                if of != name:
                    name, block, last, found = of, number, None, False
                elif number != block:
                    block, found = number, False
                    ids.append(of)
                    blocks.append(number)
                    entries.append(last)
                if not found:
                    place = b if last is None else b + int(np.searchsorted(first[b:e], last + ttl, "right"))
                    if place < e:
                        last, found = int(value[place]), True
            yield pa.RecordBatch.from_pydict({
                "event_id": pa.array(ids, pa.string()), "block": pa.array(blocks, pa.int64()), "entry": pa.array(entries, pa.int64())})

    return run


def _kept_seqs(ttl: int):
    """Arrival numbers kept among rows ``event_id, block, at, seq, entry`` sorted by id, block and time.

    A block's first row may tell the last time kept before it (``entry``). One pass: the last kept time is all that is carried.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("at").to_numpy(zero_copy_only=False)
            entered = np.asarray(batch.column("entry").is_valid())
            begin, end = _groups(batch, ("event_id", "block"))
            # of a block within the batch and one TTL that nothing comes before, the first row
            plain = (at[end - 1] - at[begin] <= ttl) & ~entered[begin]
            plain[-1] = False
            plain[0] &= open_key != (batch.column("event_id")[0].as_py(), batch.column("block")[0].as_py())
            kept = begin[plain].tolist()
            for b, e in zip(begin[~plain].tolist(), end[~plain].tolist(), strict=True):
                key = (batch.column("event_id")[b].as_py(), batch.column("block")[b].as_py())
                if key != open_key:
                    open_key, last = key, None
                place = b
                if entered[b]:
                    last, place = batch.column("entry")[b].as_py(), b + 1
                if last is not None:
                    place += int(np.searchsorted(at[place:e], last + ttl, "right"))
                while place < e:
                    kept.append(place)
                    last = int(at[place])
                    place += max(1, int(np.searchsorted(at[place:e], last + ttl, "right")))
            yield pa.RecordBatch.from_arrays([batch.column("seq").take(pa.array(kept, pa.int64()))], ["seq"])

    return run


def first_within_ttl(events: DataFrame, ttl_seconds: int = fv.DEDUP_TTL_SECONDS, block_spans: int = BLOCK_SPANS) -> DataFrame:
    """Rows kept when an id is forgotten ``ttl_seconds`` after it was last accepted.

    Replays events on their own clock, in (ts, seq) order. A repeat does not
    extend the time. What an id keeps depends on what it kept before, so its
    time is cut into blocks of ``block_spans`` times the TTL, and each block is first reduced to a
    function from the last time kept before it to the last time kept in it. Per id these functions, a
    small part of the rows, are applied one after the other; then every block is
    replayed on its own from the time it is entered with. Blocks of one id go to different tasks, and a task
    holds a batch and the steps of one function.
    """
    ttl = int(ttl_seconds) * 1_000_000
    width = max(ttl, 1) * block_spans
    timed = events.select("event_id", F.unix_micros("ts").alias("at"), "seq")
    points = timed.groupBy("event_id", "at").agg(F.min("seq").alias("seq"))
    points = points.withColumn("block", F.expr(f"(at - pmod(at, {width}L)) div {width}L"))
    dealt = points.select("event_id", "block", "at").repartition("event_id", "block").sortWithinPartitions("event_id", "block", "at")
    steps = dealt.mapInArrow(_block_steps(ttl, width), _STEPS).repartition("event_id").sortWithinPartitions("event_id", "block", "first")
    entries = steps.mapInArrow(_block_entries(ttl), "event_id string, block bigint, entry bigint")
    none = F.lit(None)
    # a block's entry is a row before all its others
    rows = points.select("event_id", "block", "at", "seq", none.cast("bigint").alias("entry")).unionByName(entries.select(
        "event_id", "block", F.lit(_BEFORE_ALL).alias("at"), none.cast(points.schema["seq"].dataType).alias("seq"), "entry"))
    replayed = rows.repartition("event_id", "block").sortWithinPartitions("event_id", "block", "at")
    kept = replayed.mapInArrow(_kept_seqs(ttl), T.StructType([points.schema["seq"]]))
    return events.join(kept, "seq", "left_semi")
