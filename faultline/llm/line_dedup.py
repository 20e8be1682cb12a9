"""Line de-duplication across documents, by keep bitmaps.

A text is split at line feeds. A line's key is the line without blanks, tabs, line feeds, vertical tabs, form feeds
and carriage returns at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code points that stand in at least
``min_docs`` documents lose all their lines, or with ``keep_first`` all but the first one by document and position.

Occurrences are pairs of 64-bit hashes of the key with document and position, without text. They are dealt by ranges
of (hash, document) and sorted by position behind these, so a task streams each key's documents in order, takes the
first occurrence in each, and a key with a third of all lines is cut between documents. Counts are summed
within tasks before they are shuffled. What comes back is a keep bitmap per document, compressed to runs of kept lines.

Rules: a document is a (doc_id, text) pair, so repeated rows count once and get the same bitmap; null ids are equal to
each other; a null or empty text is one empty line, whose key has no code point; other columns are not
read; an empty table gives an empty result. Everything runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from faultline.llm import selection
from faultline.llm.selection import text_hash, whole_rows
from faultline.llm.storage import stored

MIN_DOCS = 10
MIN_CHARS = 1

_ENDS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key that holds one of so many parts of all lines or more is sent to every task; there are no more keys than parts.
_PARTS = 2000
_KEY = ("h1", "h2")
_DOC = ("doc_id", "text_hash")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    bare = F.trim(line, F.lit(_ENDS))
    # lower() is the faster one, and the same where all is ASCII
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every line with a key that is long enough: two hashes of the key, its document, place and the document's lines."""
    split = docs.select("doc_id", text_hash().alias("text_hash"), lines_of(F.col("text")).alias("lines"))
    lines = split.select(*_DOC, F.size("lines").alias("n_lines"), F.posexplode("lines").alias("at", "line"))
    keyed = lines.select(*_DOC, "n_lines", "at", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), "key").alias("h2"), *_DOC, "at", "n_lines")


def _frequent(found: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """Keys in enough documents: their documents and lines, and with ``keep_first`` where the first stands."""
    dealt = found.select(*_KEY, *_DOC, "at").repartitionByRange(*_KEY, *_DOC)
    in_document = Window.partitionBy(*_KEY, *_DOC).orderBy("at")
    streamed = dealt.withColumn("first", F.row_number().over(in_document) == 1)
    counts = [F.count_if("first").alias("docs"), F.count("*").alias("lines")]
    if keep_first:
        counts.append(F.min(F.struct(*_DOC, "at")).alias("kept"))
    return streamed.groupBy(*_KEY).agg(*counts).filter(F.col("docs") >= min_docs)


def _of_keys(found: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """The occurrences of ``keys``, without gathering those of a common key in one task."""
    if keys.count() <= selection.BROADCAST_ROWS:
        return found.join(F.broadcast(keys), list(_KEY))
    common = F.col("lines") * _PARTS >= total
    most, others = F.broadcast(keys.filter(common)), keys.filter(~common)
    rest = found.join(most, list(_KEY), "left_anti").join(others, list(_KEY))
    return rest.unionByName(found.join(most, list(_KEY)))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """Documents of ``docs(doc_id, text)`` that lose lines: ``doc_id, text_hash, n_lines, n_dropped, keep``.

    ``keep`` holds the runs of kept lines as ``struct<start, length>``, in order; none where all lines go. A
    document that loses nothing has no row.
    """
    seen = Observation()
    found = stored(occurrences(docs, min_chars).observe(seen, F.count("*").alias("n")), "line-occurrences")
    keys = stored(_frequent(found, min_docs, keep_first), "frequent-lines")
    lines = _of_keys(found, keys, seen.get["n"])
    if keep_first:
        lines = lines.filter(~F.struct(*_DOC, "at").eqNullSafe(F.col("kept")))
    dropped = lines.groupBy(*_DOC).agg(F.first("n_lines").alias("n_lines"), F.array_sort(F.collect_set("at")).alias("gone"))
    # where a run of dropped lines begins, and the line behind one
    begins = F.filter("gone", lambda x, i: (i == 0) | (F.get("gone", i - 1) < x - 1))
    behind = F.transform(F.filter("gone", lambda x, i: (i == F.size("gone") - 1) | (F.get("gone", i + 1) > x + 1)), lambda x: x + 1)
    edged = dropped.select(*_DOC, "n_lines", F.size("gone").alias("n_dropped"),
                           F.concat(begins, F.array("n_lines")).alias("to"), F.concat(F.array(F.lit(0)), behind).alias("from"))
    runs = F.transform(F.arrays_zip("from", "to"), lambda r: F.struct(r["from"].alias("start"), (r["to"] - r["from"]).alias("length")))
    return edged.select(*_DOC, "n_lines", "n_dropped", F.filter(runs, lambda r: r["length"] > 0).alias("keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines of the runs ``keep``, in order."""
    # the outer transform binds the lines to a name, so that a text is split once and not for every run
    return F.get(F.transform(F.array(lines), lambda every: F.flatten(
        F.transform(keep, lambda r: F.slice(every, r["start"] + 1, r["length"])))), 0)


def without_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` as a column ``doc`` with ``n_lines``, ``n_dropped`` and ``kept``: the text without its dropped lines.

    Null texts come back empty. A row per row of ``docs``.
    """
    marked = bitmaps.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), "n_dropped", "keep")
    same = F.col("doc.doc_id").eqNullSafe(F.col("_doc_id")) & (F.xxhash64("doc.text") == F.col("_text_hash"))
    lines = lines_of(F.col("doc.text"))
    kept = F.when(F.col("keep").isNull(), F.coalesce("doc.text", F.lit(""))).otherwise(
        F.array_join(kept_lines(lines, F.col("keep")), "\n"))
    return whole_rows(docs).join(marked, same, "left").select(
        "doc", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def line_digests(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row of ``docs``."""
    left = without_lines(docs.select("doc_id", "text"), keep_bitmaps(docs, min_docs, min_chars, keep_first))
    return left.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
