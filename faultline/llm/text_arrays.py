"""Words, lines and shingles of many texts at once, as numpy arrays over an Arrow byte buffer.

Texts come in slices of about a megabyte, so memory follows the slice (or the longest single
text), not the batch. Hashes are 64 bits, the same for equal bytes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def table_of(characters: str) -> np.ndarray:
    """A table of 256 flags, set for the given ASCII characters."""
    table = np.zeros(256, bool)
    table[np.frombuffer(characters.encode("ascii"), np.uint8)] = True
    return table


SPACE = table_of(" \t\n\v\f\r")
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32


def mixed(values: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0xD6E8FEB86659FD93
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(known := _powers.get(name, ())) < n:
        steps = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        known = _powers[name] = np.multiply.accumulate(steps)
    return known[:n]


class Slice(NamedTuple):
    """Texts ``first`` to ``first + n`` of a column: their bytes, and ``n + 1`` offsets into them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Runs of texts of about ``limit`` bytes, at least one text each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, places, content = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Slice(first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


class Spans(NamedTuple):
    """Runs of bytes (words, lines): start and end in the slice, and the text each belongs to."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray


def spans(part: Slice, inside: np.ndarray) -> Spans:
    """Maximal runs of flagged bytes that stay within one text."""
    n = len(part.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Spans(none, none, none)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = part.offsets[(part.offsets > 0) & (part.offsets < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(first)
    return Spans(start, np.flatnonzero(last) + 1, np.searchsorted(part.offsets, start, "right") - 1)


def word_spans(part: Slice) -> Spans:
    """Runs of bytes other than blank, tab, line feed, vertical tab, form feed, carriage return."""
    return spans(part, ~SPACE[part.data])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: equal bytes, equal hash, wherever the run stands."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power("up", _BASE, n), out=total[1:])
    down = _power("down", pow(_BASE, -1, 1 << 64), n + 1)
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of ``length`` neighbours in ``values``."""
    out = np.zeros(max(len(values) - length + 1, 0), np.uint64)
    for i in range(length):
        out += values[i:i + len(out)] * np.uint64(pow(_BASE, 2 * i + 3, 1 << 64))
    return mixed(out)


def bounds(owners: np.ndarray, n: int) -> np.ndarray:
    """``n + 1`` places that cut a sorted owner array into the runs of owners 0 to n - 1."""
    return np.searchsorted(owners, np.arange(n + 1))


def shingle_sets(hashes: np.ndarray, cuts: np.ndarray, length: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``length``-word runs.

    A text with fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    runs = run_hashes(hashes, length)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= length:
            out.append(np.unique(runs[a:b - length + 1]))
        else:
            out.append(run_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def counts_within(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One Arrow list per array; 64-bit hashes are stored as signed numbers."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
