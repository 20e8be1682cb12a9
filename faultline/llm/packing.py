"""Best-fit packing of token runs into fixed-size sequences after Martello-Toth reduction.

Only lengths matter to packing, and there are at most ``capacity`` of them, so the instance is a table of
counts by length, however many documents there are. On it the driver

1. fixes bins that provably dominate every alternative for the longest item (Martello and Toth's
   criterion for sets of up to three items), and takes them out, as long as any is found;
2. packs what remains by best fit, longest first, whole counts at a time.

The result is a list of bin patterns with multiplicities. Ranks of the pieces among equal lengths, counted
by length and salt, then tell each piece its sequence and place: pieces are never gathered.

Rules: null text is an empty one, which still has the end id; repeated rows are packed one by one; other
columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import tokenizing
from faultline.llm.storage import stored

CAPACITY = 1024
_ROWS_PER_SALT = 100_000


class Pattern(NamedTuple):
    """``times`` equal bins, each with the given numbers of items by length, longest first."""

    times: int
    items: tuple[tuple[int, int], ...]


class _Counts:
    """Counts by length with the lengths present in ascending order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {k: v for k, v in counts.items() if v}
        self.lengths = sorted(self.n)

    def take(self, length: int, times: int) -> None:
        self.n[length] -= times
        if not self.n[length]:
            del self.n[length]
            self.lengths.remove(length)

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest items, one item of length ``without`` left out."""
        out = []
        for x in self.lengths:
            out += [x] * min(self.n[x] - (x == without), k - len(out))
            if len(out) == k:
                break
        return out

    def largest_upto(self, limit: int, *used: int) -> int:
        """Largest length of at most ``limit`` with an item beyond the used ones; 0 if none."""
        at = bisect.bisect_right(self.lengths, limit)
        while at:
            x = self.lengths[at - 1]
            if self.n[x] > used.count(x):
                return x
            at -= 1
        return 0


def _best_pair(left: _Counts, room: int, used: int) -> tuple[int, int]:
    """Largest sum of two other items within ``room``, and the largest smaller item of any such two."""
    best = low = 0
    for y in left.lengths:
        if 2 * y > room:
            break
        if left.n[y] == (y == used):
            continue
        x = left.largest_upto(room - y, used, y)
        if x >= y:
            best, low = max(best, x + y), max(low, y)
    return best, low


def _dominating(left: _Counts, longest: int, capacity: int) -> tuple[int, ...] | None:
    """A set with the longest item that is at least as good as any other feasible set with it, or None.

    A set dominates another if its items can take the other's, split into groups, one group an item.
    """
    room = capacity - longest
    low = left.smallest(3, longest)
    if not low or low[0] > room:
        return (longest,)
    one = left.largest_upto(room, longest)
    if one == room or len(low) < 2 or low[0] + low[1] > room:
        return longest, one
    if len(low) == 3 and sum(low) <= room:
        return None
    pair, second = _best_pair(left, room, longest)
    if one >= pair:
        return longest, one
    third = left.largest_upto(room - one, longest, one)
    return (longest, one, third) if third and third >= second else None


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Bins fixed by dominance, and the counts of the items that remain."""
    left, fixed, again = _Counts(counts), [], True
    while again:
        again = False
        for length in sorted(left.n, reverse=True):
            while left.n.get(length):
                best = _dominating(left, length, capacity)
                if best is None:
                    break
                items = tuple((x, best.count(x)) for x in dict.fromkeys(best))
                times = min(left.n[x] // c for x, c in items)
                for x, c in items:
                    left.take(x, c * times)
                fixed.append(Pattern(times, items))
                again = True
    return fixed, left.n


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first: each item goes to the open bin that it fills most; equal bins are one entry."""
    open_bins: dict[int, list[Pattern]] = defaultdict(list)
    spaces: list[int] = []

    def put(space: int, bins: Pattern) -> None:
        if not open_bins[space]:
            bisect.insort(spaces, space)
        open_bins[space].append(bins)

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                bins = open_bins[space].pop()
                if not open_bins[space]:
                    spaces.pop(at)
            else:
                space, bins = capacity, Pattern(-(-n // (capacity // length)), ())
            each = min(space // length, n)
            full = min(bins.times, n // each)
            put(space - each * length, Pattern(full, (*bins.items, (length, each))))
            n -= full * each
            if rest := bins.times - full:
                if n and n < each:
                    put(space - n * length, Pattern(1, (*bins.items, (length, n))))
                    rest, n = rest - 1, 0
                if rest and bins.items:
                    put(space, Pattern(rest, bins.items))
    return [p for group in open_bins.values() for p in group]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Bin patterns that hold exactly the given counts."""
    fixed, left = reduced(counts, capacity)
    return fixed + best_fit(left, capacity)


def _pieces(path: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for text, ids, cuts in tokenizing.token_slices(batch.column("text"), path, end_id):
                raw = memoryview(ids.astype("<u4").tobytes())
                out = []
                for k, a, b in zip(keys[text.first:text.first + text.n], cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    begin, stop, piece = a, a + ((b - a - 1) % capacity + 1), 0
                    while begin < b:
                        out.append((k, piece, begin - a, stop - begin, zlib.crc32(raw[4 * begin:4 * stop])))
                        begin, stop, piece = stop, stop + capacity, piece + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECE_TYPES, strict=True)], list(_PIECE_NAMES))

    return cut


_PIECE_NAMES = ("doc_id", "piece", "start", "length", "ids_crc32")
_PIECE_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
_PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Token runs of ``docs(doc_id, text)``: a document of more than ``capacity`` ids is cut, the first piece short."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(tokenizer, end_id, capacity), _PIECE_SCHEMA)


def _slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length, for runs of ranks: first rank, first sequence, items of that length a bin, place in the bin."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for times, items in patterns:
        place = 0
        for length, each in items:
            runs[length].append((used[length], sequence, each, place))
            used[length] += times * each
            place += length * each
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (any columns, with ``length`` from 1 to ``capacity``) plus ``sequence_id`` and ``offset``.

    A column of ``parts`` that has one of these two names, in any case, is refused: it would be lost or doubled.
    """
    if taken := [c for c in parts.columns if c.lower() in ("sequence_id", "offset")]:
        raise ValueError(f"columns with names of the result: {taken}")
    # the caller's columns travel as one struct, so that their names meet no working name
    whole = parts.select(F.struct("*").alias("part"), F.col("length"))
    parts = stored(whole.withColumn("_row", F.monotonically_increasing_id()), "packing-pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if bad := [x for x in counts if x is None or not 1 <= x <= capacity]:
        raise ValueError(f"lengths outside 1..{capacity}: {bad[:5]}")
    slots = _slots(solve(counts, capacity))

    # ranks among equal lengths: a hot length is split by salt, the salts' counts are added up
    salts = max(16, sum(counts.values()) // _ROWS_PER_SALT)
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1
    ranked = salted.withColumn("_own", own).join(before.drop("_n"), ["length", "_salt"]).withColumn(
        "_rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_salt", "_row")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, base, each, start = slots[int(x)]
                run = np.searchsorted(first, rank[at], "right") - 1
                nth = rank[at] - first[run]
                sequence[at] = base[run] + nth // each[run]
                offset[at] = start[run] + nth % each[run] * x
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), pa.array(sequence), pa.array(offset)], ["part", "sequence_id", "offset"])

    schema = ranked.select("part").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema).select("part.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """All documents in as few sequences as the reduction and best fit find; one row per piece."""
    return packed(pieces(docs, tokenizer, end_id, capacity), capacity)
