"""Quality rules from cross-document line frequency.

Every line is normalised (A-Z lower-cased, digits read as 0, white space runs as one blank, none at
the ends) and hashed. Per host, the distinct documents of each line are counted; a line is removed
where the count exceeds ``max(min_docs, share x documents of the host)``, and a document that keeps
less than ``least_share`` of its words is depleted and rejected.

A document is a row: repeated rows count one by one, whatever their ids. Null text and text without
words have no lines; they are kept or rejected by the base rules alone. A null host is a host of its
own. Other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import text_arrays as ta
from faultline.llm.storage import stored

MIN_DOCS = 20
SHARE = 0.005
LEAST_SHARE = 0.3

_SYMBOL = ta.table_of("#*$%&|<>")
_NORMAL = ta.LOWER_ASCII.copy()
_NORMAL[48:58] = 48

_SCHEMA = ("doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, lines array<long>, line_words array<int>")


def _repeat_words(runs: np.ndarray) -> int:
    """Words covered by 3-word windows (given by their hashes) that stand twice or more."""
    if len(runs) < 2:
        return 0
    _, place, count = np.unique(runs, return_inverse=True, return_counts=True)
    again = (count > 1)[place]
    covered = np.zeros(len(runs) + 2, bool)
    for i in range(3):
        covered[i:i + len(runs)] |= again
    return int(covered.sum())


def _profile(part: ta.Slice) -> dict[str, object]:
    """Base counts of each text of a slice, and its distinct normalised lines with their words."""
    data, n = part.data, part.n
    words = ta.word_spans(part)
    cuts = ta.bounds(words.text, n)
    lead = (data & 0xC0) != 0x80
    exact = ta.span_hashes(data, words.start, words.end)
    runs = ta.run_hashes(exact, 3)
    plain = ta.span_hashes(_NORMAL[data], words.start, words.end)

    lines = ta.spans(part, data != 10)
    of_word = np.searchsorted(lines.start, words.start, "right") - 1
    full, first = np.unique(of_word, return_index=True)
    size = np.diff(np.append(first, len(of_word)))
    as_is = ta.span_hashes(data, lines.start[full], lines.end[full])
    # order-sensitive sum of a line's word hashes: position in the line times an odd number
    place = (np.arange(len(of_word)) - np.repeat(first, size)).astype(np.uint64)
    weight = ta.mixed(place + np.uint64(1)) | np.uint64(1)
    total = np.add.reduceat(plain * weight, first) if len(first) else np.zeros(0, np.uint64)
    normal = ta.mixed(total)
    line_cuts = ta.bounds(lines.text[full], n)

    dup, repeat, kept, kept_words = [], [], [], []
    for i in range(n):
        a, b = cuts[i], cuts[i + 1]
        repeat.append(_repeat_words(runs[a:max(b - 2, a)]))
        a, b = line_cuts[i], line_cuts[i + 1]
        dup.append(int(b - a - len(np.unique(as_is[a:b]))))
        values, where = np.unique(normal[a:b], return_inverse=True)
        kept.append(values)
        kept_words.append(np.bincount(where, size[a:b], len(values)).astype(np.int32))
    return {
        "n_words": pa.array(np.diff(cuts), pa.int64()),
        "word_chars": pa.array(ta.counts_within(lead & ~ta.SPACE[data], part.offsets), pa.int64()),
        "n_symbols": pa.array(ta.counts_within(_SYMBOL[data], part.offsets), pa.int64()),
        "n_dup_lines": pa.array(dup, pa.int64()),
        "n_repeat_words": pa.array(repeat, pa.int64()),
        "lines": ta.list_column(kept, pa.int64()),
        "line_words": ta.list_column(kept_words, pa.int32()),
    }


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ta.slices(batch.column("text")):
            some = batch.slice(part.first, part.n)
            columns = {"doc_id": some.column("doc_id"), "host": some.column("host")} | _profile(part)
            yield pa.RecordBatch.from_pydict(columns)


def line_quality(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE,
                 least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per row of ``docs(doc_id, text, <host>)``: base counts, removed words, verdict."""
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), "text")
    # a null host is told from any named one by its first character
    named = F.coalesce(F.concat(F.lit("="), "host"), F.lit("-"))
    profiles = rows.mapInArrow(_profiles, _SCHEMA).withColumns({
        "host": named, "row": F.monotonically_increasing_id()})
    profiles = stored(profiles, "line-profiles")

    # one row per document and distinct line, so counting rows counts documents
    lines = profiles.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("line")).select(
        "row", F.xxhash64("host", "line.lines").alias("key"), "host", F.col("line.line_words").alias("words"))
    often = lines.groupBy("key", "host").agg(F.count("*").alias("docs")).filter(F.col("docs") > min_docs)
    hosts = profiles.groupBy("host").agg(F.count("*").alias("host_docs"))
    removed_lines = often.join(hosts, "host").filter(F.col("docs") > share * F.col("host_docs")).select("key")
    removed = lines.select("row", "key", "words").join(removed_lines, "key").groupBy("row").agg(
        F.sum("words").alias("removed_words"), F.count("*").alias("removed_lines"))

    out = profiles.drop("lines", "line_words", "host").join(removed, "row", "left").fillna(
        0, ["removed_words", "removed_lines"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("removed_words")) < least_share * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~(F.col("base_failed") | depleted)).drop("row")


def without_frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """``docs`` with the lines above the limit taken out of ``text``; other lines stay as they are.

    Lines without a word stay. Text that loses all its lines becomes empty; null stays null.
    """
    normal = F.trim(F.regexp_replace(F.translate(F.regexp_replace("line", "[0-9]", "0"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                                 "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))
    named = F.coalesce(F.concat(F.lit("="), F.col(f"doc.{host}").cast("string")), F.lit("-"))
    rows = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "line-rows")
    lines = rows.select("row", named.alias("host"), F.posexplode(F.split("doc.text", "\n")).alias("at", "line"))
    lines = lines.withColumn("normal", F.sha2(normal, 256)).withColumn("worded", normal != "")
    seen = lines.filter("worded").select("row", "host", "normal").distinct()
    often = seen.groupBy("host", "normal").agg(F.count("*").alias("docs")).filter(F.col("docs") > min_docs)
    hosts = rows.groupBy(named.alias("host")).agg(F.count("*").alias("all"))
    often = often.join(hosts, "host").filter(F.col("docs") > share * F.col("all")).select("host", "normal")
    left = lines.join(often, ["host", "normal"], "left_anti").groupBy("row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("left"))
    text = F.when(F.col("doc.text").isNotNull(), F.coalesce("left", F.lit("")))
    return rows.join(left, "row", "left").select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")
