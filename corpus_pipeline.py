"""The corpus pipeline: language, quality, near duplicates, benchmark items, packing.

Every stage takes the documents that its predecessor kept, as a Parquet table, and decides on all of them;
all but the last return the columns of ``documents``. Tables between stages go to the shared folder that
``spark.checkpoint.dir`` names, so a lost executor costs a re-read.

Rows with a null or empty text have no language and leave at the first stage. Repeated rows are decided
alike until one of them stays as the copy of its group. Columns beyond those used pass through up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import containment, fourier_quality, language_kernel, packing, signature_trees
from faultline.llm.runtime import prepared
from faultline.llm.storage import stored

#: Least value of the best language's score. A text that is of no learned language has 0: the operator's own cut, from
#: its training texts, tells that; the scores themselves sum to 1 and are never below 1 over the number of languages.
LEAST_LANGUAGE_SCORE = 0.2
#: Least chance of label 1.
LEAST_QUALITY = 0.5
#: Near duplicates share at least this percentage of their shingles of so many words.
NEAR_PERCENT, NEAR_SHINGLE = 80, 5
TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language (operator 5)."""
    return language_kernel.with_language(docs, LEAST_LANGUAGE_SCORE)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely good than poor (operator 10)."""
    return fourier_quality.without_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), cut=LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 2)."""
    return signature_trees.one_of_each(docs, NEAR_SHINGLE, NEAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 9)."""
    return containment.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their training sequence (operator 7)."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID)


def _prepared(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(prepared(spark), docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


STAGES = [
    ("language", _prepared(by_language)),
    ("quality", _prepared(by_quality)),
    ("near_duplicates", _prepared(near_duplicates)),
    ("benchmark", _prepared(without_benchmark)),
    ("packing", _prepared(into_sequences)),
]

#: Classifiers and tokenizers are beyond SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: one row per piece of a kept document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
