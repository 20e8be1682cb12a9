"""Token ids in directly addressable codes: any token is read without decoding its block.

An id is split into byte chunks, lowest first. Level k holds the k-th chunks of the ids that have one,
a bitmap that tells which of them go on to level k + 1, and a rank directory (set bits before each block
of 512), so the place of an id's next chunk is one directory entry and one popcount away.

A code file set is a Parquet table, so that it is written by committed tasks and read wherever Spark
reads: one row per segment of about ``SEGMENT`` ids with ``part`` (the writing task, in ascending doc_id
order), ``segment`` (from 0 in each part), ``before`` (ids of earlier segments of the part), ``n_tokens``,
``doc_ids`` (ascending within and across segments, a null id first), ``ends`` (ids of the segment up to
and with each document) and ``code``. A segment holds whole documents.

Rules: null text counts as empty, so it has the end id only; repeated rows stay, one entry each, ordered
by text among equal ids; other columns are ignored; an empty table gives an empty file set.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import tokenizing

SEGMENT = 1 << 16
_BLOCK = 512
_MAGIC = b"DAC1"

FILE_SCHEMA = ("part int, segment int, before long, n_tokens long, first_doc long, last_doc long, "
               "doc_ids array<long>, ends array<int>, code binary")


def encoded(ids: np.ndarray) -> bytes:
    """The code of a run of ids below 2**32."""
    left, levels = ids.astype(np.uint32), []
    while True:
        more = left > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (_BLOCK // 8)))
        per_block = np.bitwise_count(bits.reshape(-1, _BLOCK // 8)).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(per_block, dtype=np.uint32)])[:-1]
        levels.append((len(left), (left & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        left = left[more] >> np.uint32(8)
        if not len(left):
            break
    out = [_MAGIC, struct.pack("<I", len(levels))]
    for n, chunks, bits, ranks in levels:
        out += [struct.pack("<III", n, len(bits), len(ranks)), chunks, bits, ranks]
    return b"".join(out)


class Code:
    """Reader of one segment's code."""

    def __init__(self, blob: bytes) -> None:
        if blob[:4] != _MAGIC:
            raise ValueError("not a token code")
        (count,), at = struct.unpack_from("<I", blob, 4), 8
        self.levels = []
        for _ in range(count):
            n, n_bits, n_ranks = struct.unpack_from("<III", blob, at)
            at += 12
            self.levels.append((
                np.frombuffer(blob, np.uint8, n, at), np.frombuffer(blob, np.uint8, n_bits, at + n),
                np.frombuffer(blob, "<u4", n_ranks // 4, at + n + n_bits)))
            at += n + n_bits + n_ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """The i-th id: one chunk per level, found by rank."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // _BLOCK
            own = bits[block * _BLOCK // 8:i // 8 + 1].copy()
            own[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(own).sum())
        return value

    def all(self) -> np.ndarray:
        """All ids at once."""
        out = self.levels[0][0].astype(np.uint32)
        at = np.arange(len(out))
        for k in range(1, len(self.levels)):
            bits = self.levels[k - 1][1]
            more = np.unpackbits(bits, count=len(at), bitorder="little").astype(bool)
            at = at[more]
            out[at] |= self.levels[k][0].astype(np.uint32) << np.uint32(8 * k)
        return out


def _segments(path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = TaskContext.get().partitionId(), {"segment": 0, "before": 0}
        ids, ends, docs, size = [], [], [], 0

        def segment() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            row = {"part": [part], "segment": [state["segment"]], "before": [state["before"]], "n_tokens": [len(flat)],
                   "first_doc": [docs[0]], "last_doc": [docs[-1]], "doc_ids": [docs[:]],
                   "ends": [np.concatenate(ends).tolist()], "code": [encoded(flat)]}
            state["segment"] += 1
            state["before"] += len(flat)
            return pa.RecordBatch.from_pydict(row, schema)

        schema = pa.schema([
            ("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()),
            ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
            ("ends", pa.list_(pa.int32())), ("code", pa.binary())])
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for text, got, cuts in tokenizing.token_slices(batch.column("text"), path, end_id):
                done = 0
                while done < text.n:
                    # documents up to the one that fills the segment
                    room = cuts[done] + SEGMENT - size
                    upto = min(int(np.searchsorted(cuts, room, "left")), text.n)
                    upto = max(upto, done + 1)
                    ids.append(got[cuts[done]:cuts[upto]])
                    ends.append(cuts[done + 1:upto + 1] - cuts[done] + size)
                    docs += keys[text.first + done:text.first + upto]
                    size += int(cuts[upto] - cuts[done])
                    done = upto
                    if size >= SEGMENT:
                        yield segment()
                        ids, ends, docs, size = [], [], [], 0
        if docs:
            yield segment()

    return write


def write_codes(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> None:
    """Encode ``docs(doc_id, text)`` with the tokenizers file at ``tokenizer`` into a code file set.

    Rows are dealt by ranges of doc_id before they are tokenized, so only texts are shuffled and each task
    writes one run of the order.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(
        "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(tokenizer, end_id), FILE_SCHEMA).write.parquet(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(folder)


def _part_starts(spark: SparkSession, folder: str) -> dict[int, int]:
    """Ids before each part: one number per writing task, whatever the size of the corpus."""
    sizes = _files(spark, folder).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    out, total = {}, 0
    for row in sizes:
        out[row["part"]] = total
        total += row["n"]
    return out


def read_codes(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a file set: doc_id, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32`` of its ids as little-endian 32-bit numbers, and with ``with_ids`` the ids themselves."""
    starts = _part_starts(spark, folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Code(row["code"]).all().astype("<u4")
                ends = np.array(row["ends"], np.int64)
                cuts = np.concatenate([[0], ends])
                raw = memoryview(ids.tobytes())
                columns = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(cuts[:-1] + row["before"] + starts[row["part"]]),
                    "n_tokens": pa.array(np.diff(cuts)),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return _files(spark, folder).select("part", "before", "doc_ids", "ends", "code").mapInArrow(decode, schema)


def tokens_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """``wanted(doc_id, position)`` with the ``token`` at that place of the document, null beyond its end.

    Only the segments that hold a wanted document are read whole; of these no block is decoded.
    Repeated documents give one row for each copy; an unknown doc_id gives none.
    """
    files = _files(spark, folder)
    places = files.select("part", "segment", F.posexplode("doc_ids").alias("k", "doc_id"), "ends").select(
        "part", "segment", "doc_id", F.col("ends")[F.col("k")].alias("end"),
        F.when(F.col("k") > 0, F.col("ends")[F.col("k") - 1]).otherwise(0).alias("begin"))
    asked = wanted.select("doc_id", "position").join(places, "doc_id")
    found = asked.join(files.select("part", "segment", "code"), ["part", "segment"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                at = row["position"]
                inside = at is not None and 0 <= at < row["end"] - row["begin"]
                out.append(Code(row["code"])[row["begin"] + at] if inside else None)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "position": batch.column("position"), "token": pa.array(out, pa.int64())})

    return found.select("doc_id", F.col("position").cast("long").alias("position"), "begin", "end", "code").mapInArrow(
        pick, "doc_id long, position long, token long")
