"""Ranked lexical search of a set of items over all documents, by presence masks.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. With N documents that
have a term, L terms in all of them, n terms in one, df documents that hold a term and tf of it in one:

    w = floor(1000 ln((2N + 2) / (2 df + 1)))      m = 50 + 50 n N div L
    score = sum of w (10^9 tf div (1000 tf + 20 m)) over an item's distinct terms

One pass over the texts counts the items' terms in each document and stores these postings; counts of the corpus come
from all documents. A second pass takes the postings in blocks of documents. There each term is a bitmap over the
documents; an item's bitmaps, turned, give every document its mask of matched terms. Documents with equal masks are one
group, which can score at most the sum of its terms' largest contributions in the block. Groups are scored from the
largest such sum down, until the item's last place so far is above the next group's. Every task returns its first
documents for each item, and these are ranked.

Items are taken in blocks of at most ``BLOCK`` terms, so what tasks and driver hold of them has a fixed bound.

Rules: null and empty texts have no terms, are not counted in N and are not found; an item without terms finds
nothing; equal rows of items count once, items of one id and several texts are searched one by one; repeated rows of
documents are documents of their own; equal scores go by doc_id, a null one last; other columns are not read; an empty table
on either side gives an empty result. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from faultline.llm import text_arrays as ta
from faultline.llm.blocks import best, blocks, numbered
from faultline.llm.storage import stored

TOP = 50
BLOCK = 200_000
#: Documents and postings of a block that is held in memory at once.
_DOCS, _POSTINGS = 8192, 2_000_000
#: Documents scored before the last place is looked at again.
_STEP = 64
_NO_ID = np.iinfo(np.int64).max

_TERM = ta.table_of("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 128)


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each slice: its first text, the hash and the text of every term, and the number of texts."""
    for part in ta.slices(column):
        found = ta.spans(part, _TERM[part.data])
        yield part.first, ta.span_hashes(ta.LOWER_ASCII[part.data], found.start, found.end), found.text, part.n


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for _, hashes, owners, n in _terms(batch.column("text")):
            cuts = ta.bounds(owners, n)
            sets += [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({
            "item_id": batch.column("item_id"), "n": pa.array([len(s) for s in sets], pa.int64()), "terms": ta.list_column(sets, pa.int64())})


def _counted(vocabulary: np.ndarray):
    """Terms of each document, and how often each of the sorted ``vocabulary`` stands in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, owners, n in _terms(batch.column("text")):
                place = np.searchsorted(vocabulary, hashes)
                known = vocabulary[np.minimum(place, len(vocabulary) - 1)] == hashes
                pair, tf = np.unique(owners[known] * len(vocabulary) + place[known], return_counts=True)
                cuts = pa.array(ta.bounds(pair // len(vocabulary), n), pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(first, n), "n": pa.array(np.diff(ta.bounds(owners, n)), pa.int64()),
                    "terms": pa.ListArray.from_arrays(cuts, pa.array(pair % len(vocabulary), pa.int32())),
                    "tf": pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int64()))})

    return run


def _lengths(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents of n terms; in Python's numbers where 64 bits would not hold the product."""
    if len(n) and 50 * int(n.max()) * docs >= 1 << 63:
        return 50 + np.array([50 * x * docs // terms for x in n.tolist()], np.int64)
    return 50 + 50 * n * docs // terms


class _Postings:
    """A block of documents: contributions of their terms, and a bitmap of documents for each term."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, docs: int, terms: int) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        self.null = np.asarray(column("doc_id").is_null())
        self.ids = np.asarray(column("doc_id").fill_null(_NO_ID))
        self.first = np.asarray(column("terms").offsets).astype(np.int64)
        self.term = np.asarray(column("terms").flatten()).astype(np.int64)
        tf = np.asarray(column("tf").flatten())
        self.first -= self.first[0]
        size = np.diff(self.first)
        m = _lengths(np.asarray(column("n")), docs, terms)
        self.gain = weights[self.term] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, size)))
        self.known, place = np.unique(self.term, return_inverse=True)
        present = np.zeros((len(self.known), len(size)), bool)
        present[place, np.repeat(np.arange(len(size)), size)] = True
        self.bitmaps = np.packbits(present, axis=1)
        self.most = np.zeros(len(self.known), np.int64)
        np.maximum.at(self.most, place, self.gain)
        self.wanted = np.zeros(len(weights), bool)

    def groups(self, terms: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Documents grouped by which of ``terms`` they hold, with each group's largest possible score, best first."""
        place = np.searchsorted(self.known, terms)
        place = place[self.known[np.minimum(place, len(self.known) - 1)] == terms]
        if not len(place):
            return [], np.zeros(0, np.int64)
        bits = np.unpackbits(self.bitmaps[place], axis=1, count=len(self.ids))
        masks = np.packbits(bits, axis=0)
        masks = np.vstack([masks, np.zeros((-len(masks) % 8, masks.shape[1]), np.uint8)]).T.copy().view(np.uint64)
        some = np.flatnonzero(masks.any(axis=1))
        if masks.shape[1] == 1:
            _, one, group = np.unique(masks[some, 0], return_index=True, return_inverse=True)
        else:
            _, one, group = np.unique(masks[some], axis=0, return_index=True, return_inverse=True)
        bound = self.most[place] @ bits[:, some[one]].astype(np.int64)
        order = np.argsort(-bound, kind="stable")
        members = np.split(some[np.argsort(group.ravel(), kind="stable")], np.cumsum(np.bincount(group.ravel(), minlength=len(one)))[:-1])
        return [members[g] for g in order], bound[order]

    def scores(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Whole scores of some documents, each of which holds at least one term of the block's."""
        size = self.first[docs + 1] - self.first[docs]
        begin = np.cumsum(size) - size
        at = np.repeat(self.first[docs] - begin, size) + np.arange(size.sum())
        self.wanted[terms] = True
        gain = np.where(self.wanted[self.term[at]], self.gain[at], 0)
        self.wanted[terms] = False
        return np.add.reduceat(gain, begin)


class _Best:
    """An item's first documents so far: score, id, and whether the id is null."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.score, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def last(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.top else 0

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        null = np.concatenate([self.null, null])
        order = np.lexsort((ids, null, -score))[:self.top]
        order = order[score[order] > 0]
        self.score, self.ids, self.null = score[order], ids[order], null[order]


def _search(block: _Postings, terms: np.ndarray, found: _Best) -> None:
    groups, bounds = block.groups(terms)
    at = 0
    while at < len(groups) and bounds[at] >= max(found.last(), 1):
        taken, size = [], 0
        # groups below the last place so far can be left out at once: it only rises
        while at < len(groups) and size < _STEP and bounds[at] >= max(found.last(), 1):
            taken.append(groups[at])
            size += len(groups[at])
            at += 1
        docs = np.concatenate(taken)
        found.add(block.scores(docs, terms), block.ids[docs], block.null[docs])


def _ranked(items: list[np.ndarray], weights: np.ndarray, docs: int, terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_Best(top) for _ in items]
        for held in _gathered(batches):
            block = _Postings(held, weights, docs, terms)
            for own, of_item in zip(items, found, strict=True):
                _search(block, own, of_item)
        size = [len(f.ids) for f in found]
        if sum(size):
            ids, null = np.concatenate([f.ids for f in found]), np.concatenate([f.null for f in found])
            yield pa.RecordBatch.from_pydict({
                "item": pa.array(np.repeat(np.arange(len(items)), size), pa.int32()), "doc_id": pa.array(ids, pa.int64(), mask=null),
                "score": pa.array(np.concatenate([f.score for f in found]), pa.int64())})

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, docs, postings = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            docs, postings = docs + batch.num_rows, postings + len(batch.column("terms").flatten())
        if docs >= _DOCS or postings >= _POSTINGS:
            yield held
            held, docs, postings = [], 0, 0
    if held:
        yield held


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the first ``top`` of ``docs(doc_id, text)`` for each of ``items(item_id, text)``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().mapInArrow(
        _item_terms, "item_id long, n long, terms array<long>").filter("n > 0")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(numbered(wanted, "item-terms"), "n", BLOCK):
        rows = block.select("item_id", "terms").collect()
        hashes = [np.array(r["terms"], np.int64).view(np.uint64) for r in rows]
        out = out.union(_of_block(texts, [r["item_id"] for r in rows], hashes, top))
    return out


def _of_block(texts: DataFrame, ids: list, hashes: list[np.ndarray], top: int) -> DataFrame:
    vocabulary = np.unique(np.concatenate(hashes))
    seen = Observation()
    counted = texts.mapInArrow(_counted(vocabulary), "doc_id long, n long, terms array<int>, tf array<long>")
    counted = counted.observe(seen, F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"))
    postings = stored(counted.filter(F.size("terms") > 0), "postings")
    n_docs, n_terms = seen.get["docs"], seen.get["terms"]
    weights = np.zeros(len(vocabulary), np.int64)
    # as many rows as the block of items has terms
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    own = [np.searchsorted(vocabulary, h) for h in hashes]
    found = postings.mapInArrow(_ranked(own, weights, n_docs, n_terms, top), "item int, doc_id long, score long")
    ranks = best(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], top)
    names = F.array(*[F.lit(i).cast("long") for i in ids])
    return ranks.select(F.get(names, F.col("item")).alias("item_id"), "rank", "doc_id", "score")
