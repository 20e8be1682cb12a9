"""The registered queries of this package, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import (
    bond_negatives,
    chat_format,
    containment,
    edit_counts,
    fourier_quality,
    insult_kernel,
    language_kernel,
    line_dedup,
    line_frequency,
    oracles,
    packing,
    ranked_search,
    signature_trees,
    token_codes,
)
from faultline.llm.runtime import prepared
from faultline.llm.storage import new_path, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the line frequency rules for every document."""
    return line_frequency.line_quality(_table(spark, sf_dir, "documents"))


def op2_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have Jaccard similarity 0.9 or more."""
    found = signature_trees.jaccard_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def _records(turns: DataFrame) -> DataFrame:
    """Conversations as JSON records, in the layout that fits their roles and loses nothing."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    whole = whole.withColumn("roles", F.array_join("t.role", ","))
    text = lambda i: F.col("t")[i]["text"]
    named = lambda role, content, of: F.transform("t", lambda x: F.struct(of(x).alias(role), x["text"].alias(content)))
    spoken = F.transform("t.role", lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt"))
    record = (
        F.when(F.col("roles") == "user,assistant", F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(F.col("roles") == "system,user,assistant", F.to_json(F.struct(
            text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response"))))
        .when(F.forall(spoken, lambda r: r.isNotNull()), F.to_json(F.struct(
            named("from", "value", lambda x: F.when(x["role"] == "user", "human").otherwise("gpt")).alias("conversations"))))
        .otherwise(F.to_json(F.struct(named("role", "content", lambda x: x["role"]).alias("messages")))))
    return whole.select("conv_id", record.alias("record"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of one with control strings in its texts, read back from the template."""
    hostile = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hostile).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    done = chat_format.formatted(chat_format.canonical_turns(_records(rows)))
    back = done.select("conv_id", "layout", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"),
                       F.array_join(chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "layout")


def op4_insult_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return insult_kernel.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("text_hash")


def op5_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_kernel.languages(_table(spark, sf_dir, "documents")).drop("text_hash")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as directly addressable codes and read back."""
    folder = new_path(spark, "token-codes")
    token_codes.write_codes(_table(spark, sf_dir, "documents"), folder, _tokenizer("word_bpe_49k.json"), 1)
    return token_codes.read_codes(spark, folder)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with their sequence of at most 1024 ids and their place in it."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), 2)


def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: its source replaces 12 characters at a
    quarter, 40 characters go at the middle, its length is added at the end."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    edit = lambda start, length, insert: F.struct(
        start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), insert.alias("insert"))
    edits = F.array(edit(F.floor(n / 4), 12, F.col("source")), edit(F.floor(n / 2), 40, F.lit("")),
                    edit(F.lit(2**62), 0, F.concat(F.lit(" "), n.cast("string"))))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    path = _tokenizer("byte_bpe_50k.json")
    return edit_counts.edited_counts(stored(edit_counts.counted_texts(docs, path), "edit-trees", "zstd"), path)


def op9_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    found = containment.held_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op10_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return fourier_quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("text_hash")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped because ten documents or more hold them, and a digest of the rest."""
    return line_dedup.line_digests(_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return ranked_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its five nearest vectors of its label."""
    rows = bond_negatives.usable(_table(spark, sf_dir, "embeddings"), relabel_every=7)
    return bond_negatives.hard_negatives(rows, rows.filter(F.col("vec_id") % 100 == 0))


_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_line_frequency": (op1_line_frequency, oracles.LINE_FREQUENCY),
    "op2_signature_trees": (op2_signature_trees, oracles.SIGNATURE_TREES),
    "op3_chat_format": (op3_chat_format, oracles.CHAT_FORMAT),
    "op4_insult_kernel": (op4_insult_kernel, None),
    "op5_language_kernel": (op5_language_kernel, None),
    "op6_token_codes": (op6_token_codes, None),
    "op7_packing": (op7_packing, None),
    "op8_edit_counts": (op8_edit_counts, None),
    "op9_containment": (op9_containment, oracles.CONTAINMENT),
    "op10_fourier_quality": (op10_fourier_quality, None),
    "op11_line_dedup": (op11_line_dedup, oracles.LINE_DEDUP),
    "op12_ranked_search": (op12_ranked_search, oracles.RANKED_SEARCH),
    "op13_bond_negatives": (op13_bond_negatives, oracles.BOND_NEGATIVES),
}


def _runner(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(prepared(spark), sf_dir)

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(build) for name, (build, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}
