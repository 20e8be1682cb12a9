"""N-gram Jaccard join by signature trees.

Each text is the set of its word shingles, as 64-bit hashes. Texts with equal sets are one node, named by a hash
of the set. Nodes that could be similar share a key, so the nodes reachable over shared keys form a block, and blocks
are joined apart. A block is joined by signature trees: a tree node holds the OR of the token bitmaps and
the size range of the sets below it, and a dual traversal drops a pair of tree nodes if the largest overlap that
bitmaps and sizes allow is below the least overlap the threshold asks for. Pairs of sets that are left are
compared whole.

Keys come in two kinds. ``parts`` loses nothing: with sizes a <= b and Jaccard t or more, the sets differ
in at most D = (a + b)(1 - t)/(1 + t) shingles, so of more than D parts of the shingle space one holds the
same shingles in both; small parts are left out where enough others remain for that argument. It is
selective for thresholds of about 0.9. ``minhash`` (56 keys of 6 minima) misses a pair of similarity 0.8 with
a chance below 1e-7, more similar pairs far less often, and stays selective where many texts share passages.

Links form components; nobody lists all pairs of a group. Blocks of more than ``CHUNK`` shingles are cut by
hash: chunks are joined in themselves, then the heads of what was found, then those pairs of chunks that still
hold nodes of different components, so every pair that could add a link is compared.

Rules: null and empty texts and texts without words have no shingles and link with nothing; a text with
fewer words than a shingle has its whole sequence as its one shingle; repeated rows are copies; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import text_arrays as ta
from faultline.llm.components import components
from faultline.llm.selection import same_document, small, whole_rows
from faultline.llm.storage import stored

CHUNK = 2_000_000

_BAND_RATIO = 1.25
_PART_SIZE = 8.5
_LEAST_PART = 3
_BANDS, _MINIMA = 56, 6
_LEAF = 16


# keys

def _bands() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * _BAND_RATIO)))
    return np.array(out)


_EDGES = _bands()


def part_keys(values: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set: any set of Jaccard ``percent`` / 100 or more shares one of them."""
    n = len(values)
    first, last = (int(np.searchsorted(_EDGES, x, "right")) - 1 for x in (n, n * 100 // percent))
    weights, out = ta.mixed(values), []
    for band in range(first, last + 1):
        high = int(_EDGES[band + 1]) - 1
        differ = 2 * high * (100 - percent) // (100 + percent)
        count = max(differ + 1, int(-(-high // _PART_SIZE)))
        part = ((values >> np.uint64(20)) % np.uint64(count)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        size = np.bincount(part, minlength=count)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights[order])])
        ends = np.cumsum(size)
        content = running[ends] - running[ends - size]
        used = np.flatnonzero(size >= _LEAST_PART)
        if len(used) <= differ:
            used = np.arange(count)
        out.append(ta.mixed(content[used] + ta.mixed(used.astype(np.uint64) + np.uint64(band << 40))))
    return np.concatenate(out)


_MULTIPLIERS = (ta.mixed(np.arange(1, _BANDS * _MINIMA + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_PLACES = ta.mixed(np.arange(1, _MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def minhash_keys(values: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set: bands of minima under random orders of the shingles."""
    low, least = (values >> np.uint64(32)).astype(np.uint32), np.full(_BANDS * _MINIMA, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 256):
        x = low[a:a + 256, None] * _MULTIPLIERS
        x ^= x >> np.uint32(15)
        least = np.minimum(least, x.min(axis=0))
    bands = least.reshape(_BANDS, _MINIMA).astype(np.uint64)
    return ta.mixed((bands * _PLACES).sum(axis=1, dtype=np.uint64) + ta.mixed(np.arange(_BANDS, dtype=np.uint64)))


_KEYS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"parts": part_keys, "minhash": minhash_keys}


def _set_name(values: np.ndarray) -> int:
    """64 bits that stand for a set."""
    total = ta.mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(ta.mixed(np.array([total + np.uint64(len(values))], np.uint64)).view(np.int64)[0])


def _text_sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    for part in ta.slices(column):
        data = ta.LOWER_ASCII[part.data]
        words = ta.word_spans(part)
        yield from ta.shingle_sets(ta.span_hashes(data, words.start, words.end), ta.bounds(words.text, part.n), shingle)


# trees

class _Forest:
    """Components among the nodes of one task."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)


class _TreeNode:
    __slots__ = ("bits", "children", "docs", "high", "low", "one", "slack")

    def __init__(self, docs: np.ndarray, children: list, bits: np.ndarray, low: int, high: int, slack: int) -> None:
        self.docs, self.children, self.bits = docs, children, bits
        self.low, self.high, self.slack, self.one = low, high, slack, len(docs) == 1


class SignatureJoin:
    """Links among sets, up to connectivity: pairs already connected are not compared."""

    def __init__(self, sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> None:
        self.sets, self.percent = sets, percent
        self.size = np.array([len(s) for s in sets])
        width = 1 << int(np.clip(np.ceil(np.log2(4 * np.median(self.size) + 1)), 9, 13))
        self.bits = np.zeros((len(sets), width // 64), np.uint64)
        for row, values in zip(self.bits, sets, strict=True):
            place = (values >> np.uint64(8)) & np.uint64(width - 1)
            np.bitwise_or.at(row, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        self.set_bits = np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        self.least_hash = np.array([int(s[0] >> np.uint64(1)) for s in sets])
        self.forest, self.found = _Forest(len(sets)), []
        first: dict[int, int] = {}
        for i, label in enumerate(known or []):
            self.forest.join(first.setdefault(label, i), i)

    def tree(self, docs: np.ndarray) -> _TreeNode:
        """Tree over some sets, alike sizes and then alike contents side by side."""
        band = np.searchsorted(_EDGES, self.size[docs], "right")
        docs = docs[np.lexsort((self.least_hash[docs], band))]
        nodes = [self._leaf(docs[a:a + _LEAF]) for a in range(0, len(docs), _LEAF)]
        while len(nodes) > 1:
            nodes = [self._above(nodes[a:a + 4]) for a in range(0, len(nodes), 4)]
        return nodes[0]

    def _leaf(self, docs: np.ndarray) -> _TreeNode:
        size = self.size[docs]
        return _TreeNode(docs, [], np.bitwise_or.reduce(self.bits[docs]), int(size.min()), int(size.max()),
                         int((size - self.set_bits[docs]).max()))

    def _above(self, below: list[_TreeNode]) -> _TreeNode:
        if len(below) == 1:
            return below[0]
        return _TreeNode(np.concatenate([c.docs for c in below]), below, np.bitwise_or.reduce([c.bits for c in below]),
                         min(c.low for c in below), max(c.high for c in below), max(c.slack for c in below))

    def _all_one(self, node: _TreeNode) -> bool:
        """Whether all sets below are connected; once true it stays so."""
        if not node.one:
            below = node.children or None
            if below and not all(map(self._all_one, below)):
                return False
            heads = [c.docs[0] for c in below] if below else node.docs
            node.one = len({self.forest.find(int(d)) for d in heads}) == 1
        return node.one

    def _connected(self, a: _TreeNode, b: _TreeNode) -> bool:
        return self._all_one(a) and self._all_one(b) and self.forest.find(int(a.docs[0])) == self.forest.find(int(b.docs[0]))

    def _possible(self, a: _TreeNode, b: _TreeNode) -> bool:
        """Whether the largest overlap of any two sets below could reach the least one asked for."""
        common = int(np.bitwise_count(a.bits & b.bits).sum())
        most = min(common + min(a.slack, b.slack), a.high, b.high)
        return (100 + self.percent) * most >= self.percent * (a.low + b.low) and (
            100 * min(a.high, b.high) >= self.percent * max(a.low, b.low))

    def inside(self, node: _TreeNode) -> None:
        for child in node.children:
            self.inside(child)
        for i, a in enumerate(node.children):
            for b in node.children[i + 1:]:
                self.between(a, b)
        if not node.children:
            self._compare(node.docs, node.docs)

    def between(self, a: _TreeNode, b: _TreeNode) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._connected(a, b) or not self._possible(a, b):
                continue
            if not a.children and not b.children:
                self._compare(a.docs, b.docs)
            elif len(a.docs) >= len(b.docs):
                todo += [(c, b) for c in a.children] if a.children else [(a, c) for c in b.children]
            else:
                todo += [(a, c) for c in b.children] if b.children else [(c, b) for c in a.children]

    def _compare(self, left: np.ndarray, right: np.ndarray) -> None:
        """Pairs of two leaves: the overlap their bitmaps allow, then whole sets."""
        common = np.bitwise_count(self.bits[left][:, None] & self.bits[right][None]).sum(axis=2).astype(np.int64)
        a, b = self.size[left][:, None], self.size[right][None]
        slack = np.minimum((self.size - self.set_bits)[left][:, None], (self.size - self.set_bits)[right][None])
        most = np.minimum(np.minimum(a, b), common + slack)
        good = (100 + self.percent) * most >= self.percent * (a + b)
        if left is right:
            good = np.triu(good, 1)
        for i, k in zip(*np.nonzero(good), strict=True):
            x, y = int(left[i]), int(right[k])
            if self.forest.find(x) != self.forest.find(y) and self._similar(x, y):
                self.forest.join(x, y)
                self.found.append((x, y))

    def _similar(self, x: int, y: int) -> bool:
        short, long = sorted((self.sets[x], self.sets[y]), key=len)
        at = np.searchsorted(long, short)
        same = int((long[np.minimum(at, len(long) - 1)] == short).sum())
        return 100 * same >= self.percent * (len(short) + len(long) - same)


_BLOCK_SCHEMA = "a long, b long"


def _joined_blocks(percent: int):
    """Links of rows sorted by block: ``block`` names the group, ``side`` 0/1 tells two chunks apart (or
    -1: all with all), ``known`` is the component found so far."""

    def links(held: tuple[list, ...]) -> pa.RecordBatch:
        nodes, sets, sides, known = held
        found = []
        if len(nodes) > 1:
            join = SignatureJoin([np.frombuffer(s, np.uint64) for s in sets], percent, known)
            side = np.array(sides)
            if side[0] < 0:
                join.inside(join.tree(np.arange(len(sets))))
            elif (side == 0).any() and (side == 1).any():
                join.between(join.tree(np.flatnonzero(side == 0)), join.tree(np.flatnonzero(side == 1)))
            found = join.found
        return pa.RecordBatch.from_pydict({
            "a": pa.array([nodes[x] for x, _ in found], pa.int64()), "b": pa.array([nodes[y] for _, y in found], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])
        block = None
        for batch in batches:
            names = batch.column("block").to_pylist()
            columns = [batch.column(c).to_pylist() for c in ("node", "set", "side", "known")]
            for i, name in enumerate(names):
                if name != block:
                    if len(held[0]) > 1:
                        yield links(held)
                    held, block = ([], [], [], []), name
                for to, column in zip(held, columns, strict=True):
                    to.append(column[i])
        yield links(held)

    return run


def _block_links(rows: DataFrame, percent: int, *block: str) -> DataFrame:
    """Links of the blocks that share the named columns."""
    named = rows.select(F.to_json(F.struct(*block)).alias("block"), "node", "set", "side", "known")
    dealt = named.repartition("block").sortWithinPartitions("block")
    return stored(dealt.mapInArrow(_joined_blocks(percent), _BLOCK_SCHEMA), "tree-links")


def _with_known(rows: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).select("node", F.col("label").alias("_found"))
    return stored(rows.drop("known").join(found, "node", "left").withColumn("known", F.coalesce("_found", "node")).drop("_found"), "large-blocks")


def _tree_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links of ``blocks(node, label, set)``, enough of them to connect what is similar."""
    weight = F.sum(F.octet_length("set") / 8)
    sizes = small(stored(blocks.groupBy("label").agg(F.ceil(weight / CHUNK).alias("chunks")), "block-sizes"))
    rows = blocks.join(sizes, "label").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    rows = rows.withColumns({"side": F.lit(-1), "known": F.col("node")})
    links = _block_links(rows, percent, "label", "chunk")
    if sizes.filter("chunks > 1").isEmpty():
        return links

    # larger blocks: heads of the components found in each chunk, then chunks that still differ
    large = _with_known(rows.filter("chunks > 1"), links)
    heads = large.groupBy("label", "chunk", "known").agg(F.min("node").alias("node")).select("label", "node")
    heads = stored(heads.join(large.select("node", "set"), "node"), "block-heads")
    if 2 * heads.count() <= large.count():
        links = links.union(_tree_links(heads, percent))
        large = _with_known(large, links)
    still = large.groupBy("label").agg(F.min("known").alias("x"), F.max("known").alias("y")).filter("x <> y").select("label")
    pairs = large.join(still, "label").select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")).filter("other <> chunk")
    pairs = pairs.withColumns({
        "low": F.least("chunk", "other"), "high": F.greatest("chunk", "other"), "side": (F.col("chunk") > F.col("other")).cast("int")})
    return links.union(_block_links(pairs, percent, "label", "low", "high"))


# the join

def _sketches(shingle: int, percent: int, kind: str):
    keys_of = _KEYS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            size, name, keys = [], [], []
            for values in _text_sets(batch.column("text"), shingle):
                size.append(len(values))
                name.append(_set_name(values))
                # the keys of a set are the same each time; a task gives them once
                new = len(values) > 0 and name[-1] not in seen
                keys.append(keys_of(values, percent) if new else np.zeros(0, np.uint64))
                seen.add(name[-1])
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n_shingles": pa.array(size, pa.int64()),
                "node": pa.array(name, pa.int64()), "keys": ta.list_column(keys, pa.int64())})

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_text_sets(batch.column("text"), shingle))
            yield pa.RecordBatch.from_pydict({
                "node": pa.array([_set_name(s) for s in sets], pa.int64()), "wanted": batch.column("node"),
                "label": batch.column("label"), "set": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def _star_links(keyed: DataFrame) -> DataFrame:
    """Each node linked to the least node of each of its keys.

    Rows of a key stream through an ordered window, which holds one row at a time; a very common key is
    one of the many keys of its nodes, so it holds a small share of all rows.
    """
    least = F.first("node").over(Window.partitionBy("key").orderBy("node").rowsBetween(Window.unboundedPreceding, 0))
    return keyed.select("node", least.alias("least")).filter("node <> least").select(
        F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def jaccard_components(docs: DataFrame, shingle: int = 3, percent: int = 90, keys: str = "parts") -> DataFrame:
    """Rows of ``docs(doc_id, text)`` with the components of the links of Jaccard ``percent`` / 100 or more.

    Columns: doc_id, ``text_hash`` (xxhash64 of the text), ``n_shingles``, ``node`` (equal for equal sets),
    ``component`` (equal for what is connected; null without shingles) and ``component_id`` (least doc_id reachable, itself
    included).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _sketches(shingle, percent, keys), "doc_id long, text_hash long, n_shingles long, node long, keys array<long>"), "jaccard-sketches")
    links = stored(_star_links(sketches.select(F.explode("keys").alias("key"), "node")), "jaccard-candidates")
    labels = small(components(links))

    wanted = sketches.select("node", "doc_id").join(labels, "node").groupBy("node", "label").agg(F.min("doc_id").alias("doc_id"))
    wanted = small(stored(wanted, "jaccard-wanted"))
    texts = rows.alias("t").join(wanted.alias("w"), F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))).select("t.text", "w.node", "w.label")
    sets = texts.mapInArrow(_sets(shingle), "node long, wanted long, label long, set binary")
    blocks = stored(sets.filter("node = wanted").dropDuplicates(["node"]).select("node", "label", "set"), "jaccard-sets")
    found = small(components(_tree_links(blocks, percent)))

    members = sketches.drop("keys").join(found, "node", "left").withColumn(
        "component", F.when(F.col("n_shingles") > 0, F.coalesce("label", "node"))).drop("label")
    members = stored(members, "jaccard-members")
    least = members.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return members.join(least, "component", "left").select(
        "doc_id", "text_hash", "n_shingles", "node", "component",
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, keys: str = "minhash") -> DataFrame:
    """``docs`` with one row of each component, the one with the least doc_id; all columns stay.

    Rows without shingles stay. Of rows equal in doc_id and text one stays; a component whose ids are all
    null keeps the least text hash.
    """
    found = jaccard_components(docs, shingle, percent, keys).filter("component is not null")
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "text_hash")
    found = stored(found.select("doc_id", "text_hash", "component", place.alias("place")), "jaccard-found")
    first = found.groupBy("component").agg(F.min("place").alias("first"))
    marked = found.join(first, "component").groupBy("doc_id", "text_hash").agg(
        F.max(F.col("place") == F.col("first")).alias("_stays"), F.count("*").alias("_rows"))
    marked = small(stored(marked.filter("not _stays or _rows > 1").select("doc_id", "text_hash", "_stays"), "jaccard-verdicts"))
    joined = whole_rows(docs).join(marked, same_document(marked), "left").select("doc", marked["_stays"].alias("stays"))
    single = joined.filter("stays is null").select("doc.*")
    # rows equal in id and text: one is left by the pair alone, whatever their other columns say
    again = joined.filter("stays").select("doc", F.col("doc.doc_id").alias("id"), F.xxhash64("doc.text").alias("hash"))
    return single.union(again.dropDuplicates(["id", "hash"]).select("doc.*"))
