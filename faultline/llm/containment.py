"""Benchmark decontamination: size-partitioned MinHash containment search, verified on whole shingle sets.

Test items and documents are sets of hashed 5-word shingles (words are runs of ASCII letters and digits and of
characters beyond ASCII, lower-cased). A document holds an item if it has at least ``percent`` of the item's shingles,
wherever they stand. An item of one to four words is one shingle of its own length; a document holds it if it has that run of
words, which a second, small index by length finds.

Items are partitioned by size. An item's sketch is the bottom of a MinHash order: its k smallest shingle hashes,
where k follows from the largest size u of its partition, k = u - ceil(percent x u) + 1. A document that holds the
item misses at most k - 1 of its shingles, so it has one of the sketch: the search loses nothing, however
long the document. Documents are looked up in the sketches of the partitions that are not too large for
them, and what is found is verified on the whole sets.

Items are taken in blocks of at most ``BLOCK`` shingles, each against all documents, so what is sent to tasks has a
fixed bound. Rules: null texts and texts without words hold nothing and are held by nothing; repeated rows and items give a row each; null ids stay null; other columns are ignored; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import text_arrays as ta
from faultline.llm.blocks import blocks, numbered
from faultline.llm.selection import text_hash, without

SHINGLE = 5
PERCENT = 80
BLOCK = 1_000_000
_PARTITIONS = 8
_FILTER_BITS = 20

_WORD = ta.table_of("0123456789abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each slice: its first text, the hash and the text of every word, and the number of texts."""
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    for part in ta.slices(lowered):
        words = ta.spans(part, _WORD[part.data])
        yield part.first, ta.span_hashes(part.data, words.start, words.end), words.text, part.n


def _runs(hashes: np.ndarray, text: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words within a text, in order, and where each text's begin and end."""
    runs = ta.run_hashes(hashes, length)
    inside = text[:len(runs)] == text[length - 1:] if len(runs) else np.zeros(0, bool)
    return runs[inside], ta.bounds(text[:len(runs)][inside], n)


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, lengths = [], []
        for _, hashes, text, n in _words(batch.column("text")):
            runs, cuts = _runs(hashes, text, n, SHINGLE)
            words = ta.bounds(text, n)
            for i in range(n):
                own = hashes[words[i]:words[i + 1]]
                lengths.append(min(len(own), SHINGLE))
                short = 0 < len(own) < SHINGLE
                sets.append(ta.run_hashes(own, len(own)) if short else np.unique(runs[cuts[i]:cuts[i + 1]]))
        yield pa.RecordBatch.from_pydict({
            "item_id": batch.column("item_id"), "n": pa.array([len(s) for s in sets], pa.int64()),
            "words": pa.array(lengths, pa.int32()), "shingles": ta.list_column(sets, pa.int64())})


class RunIndex:
    """Items of fewer words than a shingle, by their number of words."""

    def __init__(self, ids: list, lengths: list[int], hashes: list[int]) -> None:
        self.ids, self.by_length = ids, {}
        for length in sorted(set(lengths)):
            own = np.array([i for i, x in enumerate(lengths) if x == length])
            keys = np.array([hashes[i] for i in own], np.uint64)
            order = np.argsort(keys, kind="stable")
            self.by_length[length] = keys[order], own[order]

    def held(self, hashes: np.ndarray, text: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """Text and item, each pair once, for texts given by their words."""
        for length, (keys, owners) in self.by_length.items():
            runs, cuts = _runs(hashes, text, n, length)
            low, high = np.searchsorted(keys, runs), np.searchsorted(keys, runs, "right")
            hit = np.flatnonzero(high > low)
            texts = np.searchsorted(cuts, hit, "right") - 1
            # equal runs of one text are one
            for at, a, b in set(zip(texts.tolist(), low[hit].tolist(), high[hit].tolist(), strict=True)):
                for i in owners[a:b].tolist():
                    yield at, i


class SketchIndex:
    """Bottom-k sketches of items by size partition, and the whole sets to verify with."""

    def __init__(self, ids: list, sets: list[np.ndarray], percent: int) -> None:
        # with no item the filter lets nothing pass
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.ids, self.sets, self.percent = [ids[i] for i in order], [sets[i] for i in order], percent
        self.need = np.array([-(-len(s) * percent // 100) for s in self.sets])
        hashes, owners = [], []
        for some in np.array_split(np.arange(len(order)), max(min(_PARTITIONS, len(order)), 1)) if order else []:
            upper = len(self.sets[some[-1]])
            k = upper - -(-upper * percent // 100) + 1
            for i in some:
                hashes.append(self.sets[i][:k])
                owners.append(np.full(len(hashes[-1]), i))
        hashes = np.concatenate([np.zeros(0, np.uint64), *hashes])
        owners = np.concatenate([np.zeros(0, np.int64), *owners])
        by = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[by], owners[by]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def held(self, runs: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Text, item and number of shared shingles, for texts given by their shingles in order."""
        maybe = np.flatnonzero(self.filter[(runs >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        low, high = np.searchsorted(self.hashes, runs[maybe]), np.searchsorted(self.hashes, runs[maybe], "right")
        hit = high > low
        maybe, low, high = maybe[hit], low[hit], high[hit]
        texts = np.searchsorted(cuts, maybe, "right") - 1
        found: dict[int, set[int]] = {}
        for text, a, b in zip(texts.tolist(), low.tolist(), high.tolist(), strict=True):
            found.setdefault(text, set()).update(self.owners[a:b].tolist())
        for text, items in found.items():
            own = runs[cuts[text]:cuts[text + 1]]
            items = [i for i in items if self.need[i] <= len(own)]
            if items:
                own = np.unique(own)
                for i in sorted(items):
                    place = np.searchsorted(own, self.sets[i])
                    shared = int((own[np.minimum(place, len(own) - 1)] == self.sets[i]).sum())
                    if shared >= self.need[i]:
                        yield text, i, shared


def _search(index: SketchIndex, short: RunIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, items, shared, sizes = [], [], [], []
            for first, hashes, texts, count in _words(batch.column("text")):
                for text, item, n in index.held(*_runs(hashes, texts, count, SHINGLE)):
                    rows.append(first + text)
                    items.append(index.ids[item])
                    shared.append(n)
                    sizes.append(len(index.sets[item]))
                for text, item in short.held(hashes, texts, count):
                    rows.append(first + text)
                    items.append(short.ids[item])
                    shared.append(1)
                    sizes.append(1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())),
                "text_hash": batch.column("text_hash").take(pa.array(rows, pa.int64())),
                "item_id": pa.array(items, pa.int64()), "n_shared": pa.array(shared, pa.int64()), "n_item_shingles": pa.array(sizes, pa.int64())})

    return run


def held_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)`` and each of ``items(item_id, text)`` that it holds.

    Columns: doc_id, text_hash, item_id, n_shared and n_item_shingles.
    """
    spark = docs.sparkSession
    sets = numbered(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        _item_sets, "item_id long, n long, words int, shingles array<long>").filter("n > 0"), "item-sets")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    schema = "doc_id long, text_hash long, item_id long, n_shared long, n_item_shingles long"
    out = spark.createDataFrame([], schema)
    for block in blocks(sets, "n", BLOCK):
        got = block.select("item_id", "words", "shingles").collect()
        whole, short = [r for r in got if r["words"] == SHINGLE], [r for r in got if r["words"] < SHINGLE]
        index = SketchIndex([r["item_id"] for r in whole], [np.array(r["shingles"], np.int64).view(np.uint64) for r in whole], percent)
        runs = RunIndex([r["item_id"] for r in short], [r["words"] for r in short], [r["shingles"][0] & (2**64 - 1) for r in short])
        out = out.union(rows.mapInArrow(_search(index, runs), schema))
    return out


def decontaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay."""
    return without(docs, held_items(docs, items, percent))
