"""Token counts of edited documents, by re-encoding only what an edit touches.

A document is cut into chunks where its tokenizer always cuts; a segment tree over the chunks keeps sums of characters
and tokens. An edit finds its first and last chunk by the sums of characters, takes ``CONTEXT`` chunks more on
both sides (a cut depends on the character before it and on two after it, one in white space on the next word), cuts and encodes that region anew, puts
the new chunks in place of the old ones and updates the sums above them. What lies outside is not read. Trees are kept between
batches of edits as a table of their leaves beside the text (``counted_texts``, ``apply_edits``).

Edits are (start, length, insert) in code points of the text as the edits before left it. Start and end beyond the text are
moved to its end, negative ones to 0; null start or length count as 0, a null insert as empty. Null text is empty text.
Texts that the tokenizer may cut differently (white space beyond ASCII, unknown pre-tokenizers) are one
chunk, so they are encoded whole. Repeated rows are counted one by one, other columns of the input are ignored, an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from faultline.llm import text_arrays as ta
from faultline.llm.tokenizing import Encoder, encoder, odd_space

CONTEXT = 2
_WHITE = " \t\n\v\f\r"
_BLOCK = 64

EDITS = "array<struct<start:long,length:long,insert:string>>"
COUNTS = "n_tokens long, n_chunks long, n_edits long, n_tokens_edited long, chars_encoded_again long"
_COUNT_NAMES = [c.split()[0] for c in COUNTS.split(", ")]
_COUNT_FIELDS = [StructField(c, LongType()) for c in _COUNT_NAMES]
_LEAVES = [StructField(c, ArrayType(IntegerType())) for c in ("chunk_chars", "chunk_tokens")]


class SegmentTree:
    """Sums of characters and tokens over chunks: blocks of chunks at the leaves, pairs of sums above."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.blocks = [(chars[a:a + _BLOCK], tokens[a:a + _BLOCK]) for a in range(0, max(len(chars), 1), _BLOCK)]
        cuts = np.arange(0, max(len(chars), 1), _BLOCK)
        sums = np.add.reduceat(np.stack([chars, tokens], axis=1), cuts) if len(chars) else np.zeros((1, 2), np.int64)
        self._build(sums)

    def _build(self, sums: np.ndarray) -> None:
        low = self.width = 1 << max(len(sums) - 1, 0).bit_length()
        self.sums = np.zeros((2 * low, 2), np.int64)
        self.sums[low:low + len(sums)] = sums
        while low > 1:
            self.sums[low // 2:low] = self.sums[low:2 * low].reshape(-1, 2, 2).sum(axis=1)
            low //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of all chunks, from which the tree can be built again."""
        return np.concatenate([c for c, _ in self.blocks]), np.concatenate([t for _, t in self.blocks])

    def find(self, place: int) -> tuple[int, int, int]:
        """Block, chunk in it and first character of the chunk that holds character ``place`` (the last chunk
        for the end of the text)."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if place >= before + self.sums[node, 0] and self.sums[node + 1, 0]:
                before += int(self.sums[node, 0])
                node += 1
        block = node - self.width
        ends = before + np.cumsum(self.blocks[block][0])
        chunk = min(int(np.searchsorted(ends, place, "right")), max(len(ends) - 1, 0))
        return block, chunk, int(ends[chunk - 1]) if chunk else before

    def back(self, block: int, chunk: int, begin: int, steps: int) -> tuple[int, int, int]:
        """The chunk ``steps`` before, or the first."""
        while steps and (block or chunk):
            if chunk:
                chunk -= 1
            else:
                block -= 1
                chunk = len(self.blocks[block][0]) - 1
            begin -= int(self.blocks[block][0][chunk])
            steps -= 1
        return block, chunk, begin

    def onward(self, block: int, chunk: int, begin: int, steps: int) -> tuple[int, int, int]:
        """The chunk ``steps`` after, or the last, and its end."""
        end = begin + int(self.blocks[block][0][chunk]) if len(self.blocks[block][0]) else begin
        while steps:
            if chunk + 1 < len(self.blocks[block][0]):
                chunk += 1
            elif block + 1 < len(self.blocks):
                block, chunk = block + 1, 0
            else:
                break
            end += int(self.blocks[block][0][chunk])
            steps -= 1
        return block, chunk, end

    def replace(self, first: tuple[int, int], last: tuple[int, int], chars: np.ndarray, tokens: np.ndarray) -> None:
        """Put new chunks in place of those from ``first`` to ``last``, both included."""
        (a, i), (b, k) = first, last
        new = tuple(np.concatenate([self.blocks[a][x][:i], got, self.blocks[b][x][k + 1:]]) for x, got in ((0, chars), (1, tokens)))
        if a == b and 0 < len(new[0]) <= 2 * _BLOCK:
            self.blocks[a] = new
            node, change = self.width + a, np.array([new[0].sum(), new[1].sum()]) - self.sums[self.width + a]
            while node:
                self.sums[node] += change
                node //= 2
        else:
            pieces = [(new[0][x:x + _BLOCK], new[1][x:x + _BLOCK]) for x in range(0, len(new[0]), _BLOCK)]
            self.blocks[a:b + 1] = pieces
            self.blocks = self.blocks or [new]
            self._build(np.array([[c.sum(), t.sum()] for c, t in self.blocks], np.int64))


def chunk_counts(tokenizer: Encoder, part: ta.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters and tokens of each chunk of a slice's texts, and where each text's chunks begin and end.

    Characters between chunks belong to the chunk before them, or the first.
    """
    lead = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
    length = lead[part.offsets[1:]] - lead[part.offsets[:-1]]
    got = tokenizer.chunk_sizes(part)
    if got is None:
        _, cuts = tokenizer.encode(part)
        return length, np.diff(cuts), np.arange(part.n + 1)
    found, sizes = got
    odd = odd_space(part) if len(part.data) else np.zeros(part.n, bool)
    cuts = ta.bounds(found.text, part.n)
    start = found.start.copy()
    has = cuts[1:] > cuts[:-1]
    start[cuts[:-1][has]] = part.offsets[:-1][has]
    end = np.append(start[1:], 0)
    end[cuts[1:][has] - 1] = part.offsets[1:][has]
    chars = lead[end] - lead[start]
    if not (odd | ~has).any():
        return chars, sizes, cuts
    # a text without chunks, or one the library must encode whole, is one chunk
    texts = [part.data[part.offsets[i]:part.offsets[i + 1]].tobytes().decode() for i in np.flatnonzero(odd)]
    whole = dict(zip(np.flatnonzero(odd).tolist(), map(len, tokenizer.encode_texts(texts)), strict=True))
    lists = [(np.array([length[i]]), np.array([whole.get(i, 0)])) if odd[i] or not has[i]
             else (chars[cuts[i]:cuts[i + 1]], sizes[cuts[i]:cuts[i + 1]]) for i in range(part.n)]
    return (np.concatenate([c for c, _ in lists]), np.concatenate([t for _, t in lists]),
            np.concatenate([[0], np.cumsum([len(c) for c, _ in lists])]))


class CountedText:
    """A text with the segment tree of its chunks."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.text, self.tree, self.encoded = text, SegmentTree(chars, tokens), 0
        self.first, self.last = (0, 0), (0, 0)

    def cut(self, start: int, length: int, insert: str) -> str:
        """Edit the text; the region whose chunks have to be counted anew."""
        start = min(max(start, 0), len(self.text))
        stop = min(start + max(length, 0), len(self.text))
        tree = self.tree
        a = tree.back(*tree.find(start), CONTEXT)
        b = tree.onward(*tree.find(max(stop - 1, start)), CONTEXT)
        # white space is cut by what follows it, so a region ends with a word or the text
        while b[2] < len(self.text) and self.text[b[2] - 1] in _WHITE:
            b = tree.onward(b[0], b[1], b[2] - int(tree.blocks[b[0]][0][b[1]]), 1)
        region = self.text[a[2]:start] + insert + self.text[stop:b[2]]
        self.text = self.text[:start] + insert + self.text[stop:]
        self.first, self.last = a[:2], b[:2]
        return region

    def whole(self) -> str:
        """The whole text as the region."""
        self.first, self.last = (0, 0), (len(self.tree.blocks) - 1, len(self.tree.blocks[-1][0]) - 1)
        return self.text

    def put(self, region: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.encoded += len(region)
        self.tree.replace(self.first, self.last, chars, tokens)

    @property
    def one_chunk(self) -> bool:
        """Whether the text may be one that only the library cuts; it stays so until it is encoded anew."""
        return len(self.tree.blocks) == 1 and len(self.tree.blocks[0][0]) <= 1


def edit_all(tokenizer: Encoder, edited: list[tuple[CountedText, int, int, str]]) -> None:
    """One edit (start, length, insert) of each text; their regions are cut and encoded together."""
    regions = []
    for counted, start, length, insert in edited:
        alone = counted.one_chunk
        region = counted.cut(start, length, insert)
        regions.append(counted.whole() if alone else region)
    column, done = pa.array(regions, pa.large_string()), 0
    for part in ta.slices(column):
        odd = odd_space(part) if len(part.data) else np.zeros(part.n, bool)
        chars, tokens, cuts = chunk_counts(tokenizer, part)
        for i in range(part.n):
            counted, region = edited[done + i][0], regions[done + i]
            if odd[i] and region is not counted.text:
                # the edit brought such white space: the text is one chunk from now on
                region = counted.whole()
                own = chunk_counts(tokenizer, next(ta.slices(pa.array([region]))))
                counted.put(region, own[0], own[1])
            else:
                counted.put(region, chars[cuts[i]:cuts[i + 1]], tokens[cuts[i]:cuts[i + 1]])
        done += part.n


def _whole_table(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        for batch in batches:
            for part in ta.slices(batch.column("text")):
                rows = batch.slice(part.first, part.n)
                chars, tokens, cuts = chunk_counts(tokenizer, part)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, _lists(chars, cuts), _lists(tokens, cuts)], names=[*rows.schema.names, "chunk_chars", "chunk_tokens"])

    return run


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))


def counted_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs(doc_id, text)`` with the leaves of each text's tree: ``chunk_chars`` and ``chunk_tokens``, one number a chunk.

    This is the form in which trees are kept: write it as a table, and every later batch of edits starts from it without an
    encoding. All columns stay; ones of these two names are replaced. Nothing is shuffled.
    """
    rows = docs.drop("chunk_chars", "chunk_tokens")
    schema = StructType([*rows.schema.fields, *_LEAVES])
    return rows.mapInArrow(_whole_table(tokenizer), schema)


def _kept_trees(tokenizer: Encoder, rows: pa.RecordBatch, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Leaves of each text as the row keeps them; those without any, or of another length than the text, are counted anew."""
    kept = [[None if x is None else np.asarray(x, np.int64) for x in _arrays(rows.column(c))] for c in ("chunk_chars", "chunk_tokens")]
    out = list(zip(*kept, strict=True))
    stale = [i for i, (c, t) in enumerate(out) if c is None or t is None or not len(c) or len(c) != len(t) or c.sum() != len(texts[i])]
    if stale:
        done = 0
        for part in ta.slices(pa.array([texts[i] for i in stale], pa.large_string())):
            chars, tokens, cuts = chunk_counts(tokenizer, part)
            for k in range(part.n):
                out[stale[done + k]] = chars[cuts[k]:cuts[k + 1]], tokens[cuts[k]:cuts[k + 1]]
            done += part.n
    return out


def _arrays(column: pa.Array) -> Iterator[np.ndarray | None]:
    flat, cuts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    valid = column.is_valid().to_pylist()
    for a, b, there in zip(cuts[:-1].tolist(), cuts[1:].tolist(), valid, strict=True):
        yield flat[a:b] if there else None


def _edited(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        for batch in batches:
            for part in ta.slices(batch.column("text")):
                rows = batch.slice(part.first, part.n)
                given, edits = rows.column("text").to_pylist(), rows.column("edits").to_pylist()
                texts = [t or "" for t in given]
                all_counted = [CountedText(t, *leaves) for t, leaves in zip(texts, _kept_trees(tokenizer, rows, texts), strict=True)]
                before = [(c.tree.tokens, sum(len(b[0]) for b in c.tree.blocks)) for c in all_counted]
                for k in range(max((len(e or ()) for e in edits), default=0)):
                    edit_all(tokenizer, [
                        (c, e[k]["start"] or 0, e[k]["length"] or 0, e[k]["insert"] or "")
                        for c, e in zip(all_counted, edits, strict=True) if e and k < len(e) and e[k] is not None])
                columns = {name: rows.column(name) for name in (rows.schema.names if keep else ["doc_id"]) if name != "edits"}
                if keep:
                    leaves = [c.tree.leaves() for c in all_counted]
                    cuts = np.concatenate([[0], np.cumsum([len(c) for c, _ in leaves])])
                    columns["text"] = pa.array([c.text if e else t for c, t, e in zip(all_counted, given, edits, strict=True)], rows.column("text").type)
                    for place, name in enumerate(("chunk_chars", "chunk_tokens")):
                        columns[name] = _lists(np.concatenate([x[place] for x in leaves]), cuts)
                yield pa.RecordBatch.from_pydict(columns | {
                    "n_tokens": pa.array([n for n, _ in before], pa.int64()), "n_chunks": pa.array([n for _, n in before], pa.int64()),
                    "n_edits": pa.array([len(e or ()) for e in edits], pa.int64()),
                    "n_tokens_edited": pa.array([c.tree.tokens for c in all_counted], pa.int64()),
                    "chars_encoded_again": pa.array([c.encoded for c in all_counted], pa.int64())})

    return run


def _with_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    rows = docs if {"chunk_chars", "chunk_tokens"} <= set(docs.columns) else counted_texts(docs, tokenizer)
    return rows.withColumns({"edits": F.col("edits").cast(EDITS), "chunk_chars": F.col("chunk_chars").cast("array<int>"),
                             "chunk_tokens": F.col("chunk_tokens").cast("array<int>")})


def apply_edits(counted: DataFrame, tokenizer: str) -> DataFrame:
    """``counted_texts`` with an ``edits`` column, after the edits: edited text, its tree's leaves and ``COUNTS``.

    Only the regions of the edits are encoded. The result keeps the other columns, loses ``edits`` and is the input of the next
    batch of edits (counts of an earlier batch are replaced). The leaves belong to the text beside them; a row whose leaves are null or do not add up to
    its text's length is counted anew, so new documents may come with null ones. A null text without edits stays null.
    """
    rows = _with_trees(counted.drop(*_COUNT_NAMES), tokenizer)
    schema = StructType([f for f in rows.schema.fields if f.name != "edits"] + _COUNT_FIELDS)
    return rows.mapInArrow(_edited(tokenizer, True), schema)


def edited_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Token counts of ``docs(doc_id, text, edits)`` before and after the edits, which apply in order.

    Starts from the kept trees where ``docs`` comes from ``counted_texts``, else builds them. Columns: doc_id and ``COUNTS``;
    chars_encoded_again counts the characters of the regions that the edits made it encode anew. Nothing is shuffled.
    """
    known = [c for c in ("chunk_chars", "chunk_tokens") if c in docs.columns]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits", *(known if len(known) == 2 else []))
    return _with_trees(rows, tokenizer).mapInArrow(_edited(tokenizer, False), f"doc_id long, {COUNTS}")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with the array of their ``edits(doc_id, seq, start, length, insert)`` in order of seq.

    All edits of a document are gathered, since each starts from what the one before left; edits of unknown
    documents are dropped. A column ``edits`` of ``docs`` is replaced.
    """
    listed = edits.groupBy("doc_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "start", "length", "insert"))),
        lambda e: F.struct(e["start"].cast("long").alias("start"), e["length"].cast("long").alias("length"), e["insert"].alias("insert"))).alias("edits"))
    return docs.drop("edits").join(listed, "doc_id", "left")
