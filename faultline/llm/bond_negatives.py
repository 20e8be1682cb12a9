"""Hard negatives by a vertical scan over columns of vectors.

Components are taken as floor(256 x); a score is the integer inner product with the anchor. An anchor's positives are
its ``positives`` highest rows of the same label; for each of these the first ``negatives`` rows of other labels with

    low x positive_score <= 100 x negative_score <= high x positive_score

are returned. Equal scores go by the smaller vec_id.

Rows are held in blocks, one column per dimension. An anchor reads the columns in the order of its own largest
magnitudes and adds up partial scores. What the columns left can still add at least and at most follows from their
smallest and largest values in the block. A row whose highest score is below the last place so far, or whose range
misses all windows, leaves the anchor's candidates; later columns are read for those that stay. After the last column scores are
exact. Every task returns its first rows for each anchor, and these are ranked.

Two scans: positives first, since they set the windows of the second. Anchors are taken in blocks of at most ``BLOCK``
components, so what tasks and driver hold of them has a fixed bound.

Rules: rows with a null label or vector, or a null or non-finite component, take no part. A null vec_id
is no anchor and comes last among equals. Rows of the anchor's own vec_id are neither its positives nor its negatives.
Repeated rows are rows of their own, but a repeated anchor counts once; anchors of one vec_id that differ
are mined one by one. Vectors of different lengths are compared as if zeros followed. Scores that 64 bits do not hold raise
an error. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.blocks import best, blocks, numbered

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SCALE = 256
#: Components of the anchors of one block, and of the rows of a block that is scanned at once.
BLOCK, _ROWS = 4_000_000, 1_000_000
#: Columns read before candidates are looked at again.
_COLUMNS = 8
_NO_ID = np.iinfo(np.int64).max


def usable(rows: DataFrame, relabel_every: int = 0) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part; every so manieth vec_id gets the next of ten labels."""
    label = F.col("label").cast("long")
    if relabel_every:
        label = F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % 10).otherwise(label)
    part = F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))

    def whole(x: Column) -> Column:
        scaled = F.floor(F.lit(float(SCALE)) * x.cast("double"))
        return F.when(F.abs(x.cast("double")) < 2.0**40, scaled).otherwise(
            F.raise_error(F.lit("a component is too large for 64-bit scores")).cast("bigint"))

    return rows.filter(part).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform("embedding", whole).alias("v"))


class _Anchor:
    """An anchor with its columns by descending magnitude."""

    def __init__(self, vec_id: int, label: int, vector: list[int]) -> None:
        self.vec_id, self.label, self.v = vec_id, label, np.array(vector, np.int64)
        order = np.argsort(-np.abs(self.v), kind="stable")
        self.order = order[self.v[order] != 0]


class _Columns:
    """A block of rows, by dimension, sorted by label."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        label = np.asarray(column("label"))
        order = np.argsort(label, kind="stable")
        self.label = label[order]
        self.null = np.asarray(column("vec_id").is_null())[order]
        self.ids = np.asarray(column("vec_id").fill_null(_NO_ID))[order]
        vectors = column("v")
        cuts = np.asarray(vectors.offsets).astype(np.int64)
        size = np.diff(cuts)
        flat = np.asarray(vectors.flatten())
        dense = np.zeros((len(size), int(size.max(initial=0))), np.int64)
        dense[np.arange(dense.shape[1]) < size[:, None]] = flat
        self.by_dimension = np.ascontiguousarray(dense[order].T)
        self.low, self.high = self.by_dimension.min(axis=1), self.by_dimension.max(axis=1)
        self.most = int(np.abs(flat).max(initial=0))

    def same_label(self, anchor: _Anchor) -> np.ndarray:
        a, b = np.searchsorted(self.label, [anchor.label, anchor.label + 1])
        return np.arange(a, b)[self.ids[a:b] != anchor.vec_id]

    def other_labels(self, anchor: _Anchor) -> np.ndarray:
        a, b = np.searchsorted(self.label, [anchor.label, anchor.label + 1])
        some = np.concatenate([np.arange(a), np.arange(b, len(self.label))])
        return some[self.ids[some] != anchor.vec_id]

    def scan(self, anchor: _Anchor, rows: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that ``keep(lowest, highest)`` leaves after every few columns, with exact scores at the end."""
        order = anchor.order[anchor.order < len(self.by_dimension)]
        own = anchor.v[order]
        if len(order) * self.most * int(np.abs(own).max(initial=0)) >= 1 << 62:
            raise ValueError("scores do not fit 64 bits")
        # what the columns from the i-th on add at least and at most
        ends = np.sort(np.stack([own * self.low[order], own * self.high[order]]), axis=0)
        least, most = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in ends)
        score = np.zeros(len(rows), np.int64)
        for i in range(0, len(order), _COLUMNS):
            for d, weight in zip(order[i:i + _COLUMNS], own[i:i + _COLUMNS], strict=True):
                score += weight * self.by_dimension[d][rows]
            j = min(i + _COLUMNS, len(order))
            stay = keep(score + least[j], score + most[j])
            if stay is not None and not stay.all():
                rows, score = rows[stay], score[stay]
            if not len(rows):
                break
        return rows, score


class _Best:
    """First rows so far: score, id, and whether the id is null."""

    def __init__(self, count: int) -> None:
        self.count = count
        self.score, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, block: _Columns, rows: np.ndarray, score: np.ndarray) -> None:
        score = np.concatenate([self.score, score])
        ids, null = np.concatenate([self.ids, block.ids[rows]]), np.concatenate([self.null, block.null[rows]])
        order = np.lexsort((ids, null, -score))[:self.count]
        self.score, self.ids, self.null = score[order], ids[order], null[order]

    def last_place(self, lowest: np.ndarray) -> int | None:
        """A score that the last place has at least, given what some candidates reach; None while there are too few."""
        reached = np.concatenate([self.score, lowest])
        return int(np.partition(reached, -self.count)[-self.count]) if len(reached) >= self.count else None


def _positives(anchor: _Anchor, block: _Columns, found: _Best) -> None:
    def keep(lowest: np.ndarray, highest: np.ndarray) -> np.ndarray | None:
        last = found.last_place(lowest)
        return None if last is None else highest >= last

    found.add(block, *block.scan(anchor, block.same_label(anchor), keep))


def _negatives(anchor: _Anchor, block: _Columns, windows: list[tuple[int, int]], found: list[_Best]) -> None:
    def keep(lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
        spread = int(highest[0] - lowest[0]) if len(lowest) else 0
        stay = np.zeros(len(lowest), bool)
        for (low, high), of_window in zip(windows, found, strict=True):
            least = low
            if spread <= high - low:
                # rows that are inside for certain set a last place
                last = of_window.last_place(lowest[(lowest >= low) & (highest <= high)])
                least = low if last is None else max(low, last)
            stay |= (highest >= least) & (lowest <= high)
        return stay

    rows, score = block.scan(anchor, block.other_labels(anchor), keep)
    for (low, high), of_window in zip(windows, found, strict=True):
        inside = (score >= low) & (score <= high)
        of_window.add(block, rows[inside], score[inside])


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[_Columns]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column("v").flatten()) + batch.num_rows
        if size >= _ROWS:
            yield _Columns(held)
            held, size = [], 0
    if held:
        yield _Columns(held)


def _found(columns: dict[str, list], found: list[_Best]) -> Iterator[pa.RecordBatch]:
    """Rows of what was found, each with the values of its place in ``columns``."""
    size = [len(f.ids) for f in found]
    if sum(size):
        at = pa.array(np.repeat(np.arange(len(found)), size), pa.int64())
        ids, null = np.concatenate([f.ids for f in found]), np.concatenate([f.null for f in found])
        yield pa.RecordBatch.from_pydict({name: pa.array(values, pa.int64()).take(at) for name, values in columns.items()} | {
            "found_id": pa.array(ids, pa.int64(), mask=null), "score": pa.array(np.concatenate([f.score for f in found]), pa.int64())})


def _scan_positives(anchors: list[_Anchor], count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_Best(count) for _ in anchors]
        for block in _blocks_of(batches):
            for anchor, of_anchor in zip(anchors, found, strict=True):
                _positives(anchor, block, of_anchor)
        yield from _found({"anchor": list(range(len(anchors)))}, found)

    return run


def _scan_negatives(anchors: list[_Anchor], positives: list[list], count: int):
    """``positives``: for each anchor its positives as (id, score, lowest, highest negative score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[_Best(count) for _ in own] for own in positives]
        for block in _blocks_of(batches):
            for anchor, own, of_anchor in zip(anchors, positives, found, strict=True):
                if own:
                    _negatives(anchor, block, [(low, high) for _, _, low, high in own], of_anchor)
        flat = [(a, i, anchors[a].vec_id, p[0], p[1]) for a, own in enumerate(positives) for i, p in enumerate(own)]
        names = ["anchor", "place", "anchor_id", "positive_id", "positive_score"]
        columns = {name: [row[i] for row in flat] for i, name in enumerate(names)}
        yield from _found(columns, [f for own in found for f in own])

    return run


_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH) -> DataFrame:
    """Negatives of ``anchors`` among ``rows``, both with ``vec_id, label, v`` as ``usable`` gives them.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    spark = rows.sparkSession
    wanted = numbered(anchors.select("vec_id", "label", "v").distinct().withColumn("n", F.size("v") + 1), "anchors")
    out = spark.createDataFrame([], _OUT)
    by_score = [F.desc("score"), F.asc_nulls_last("found_id")]
    for block in blocks(wanted, "n", BLOCK):
        own = [_Anchor(r["vec_id"], r["label"], r["v"]) for r in block.select("vec_id", "label", "v").collect()]
        first = rows.mapInArrow(_scan_positives(own, positives), "anchor long, found_id long, score long")
        chosen = [[] for _ in own]
        # at most a few rows for each anchor of the block
        for r in best(first, ["anchor"], by_score, positives).orderBy("anchor", "rank").collect():
            score = r["score"]
            chosen[r["anchor"]].append((r["found_id"], score, -(-low * score // 100), high * score // 100))
        schema = "anchor long, place long, anchor_id long, positive_id long, positive_score long, found_id long, score long"
        second = rows.mapInArrow(_scan_negatives(own, chosen, negatives), schema)
        out = out.union(best(second, ["anchor", "place"], by_score, negatives).select(
            "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out
