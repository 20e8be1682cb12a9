"""Stored JSON documents: packages and investigation results, one per file or line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import documents as doc
from faultline.functions.once import with_computed
from faultline.operators.conformance import check_packages
from faultline.operators.gate import CONFIDENCE_FIELD, document_violations, result_schema, result_violations


def read_texts(spark: SparkSession, path: str, per_file: bool = True) -> DataFrame:
    """``file, text`` of whole files, or of the lines of JSON-lines files."""
    lines = spark.read.text(path, wholetext=per_file)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_packages(spark: SparkSession, path: str, per_file: bool = True) -> DataFrame:
    """``file, package, incident_id, violations``: raw-schema packages, checked."""
    texts = read_texts(spark, path, per_file).withColumnRenamed("text", "package")
    checked = check_packages(texts)
    return checked.withColumn("incident_id", F.get_json_object("package", "$.incident_id"))


def read_results(
    spark: SparkSession, path: str, per_file: bool = True, confidence_field: str = CONFIDENCE_FIELD
) -> DataFrame:
    """Investigation results as columns, plus ``file`` and ``violations``."""
    return parse_results(read_texts(spark, path, per_file), confidence_field)


def parse_results(texts: DataFrame, confidence_field: str = CONFIDENCE_FIELD) -> DataFrame:
    """``texts`` (with ``text``) as result columns plus ``violations``, of types first, then of values."""
    columns = ",".join(part.replace(" ", ":", 1) for part in result_schema(confidence_field).split(", "))
    texts = (
        texts.withColumn("_sealed", doc.sealed_document(F.col("text")))
        .withColumn("_document", doc.unsealed_document(F.col("_sealed"), F.col("text")))
    )
    kept = [c for c in texts.columns if c not in ("text", "_sealed", "_document")]
    texts = with_computed(
        texts, F.try_variant_get("_document", "$", f"struct<{columns}>").alias("_row"),
        document_violations(F.col("_document"), confidence_field).alias("_types"))
    rows = texts.select(*kept, "_types", F.col("_row").isNull().alias("_bad"), "_row.*")
    found = F.when(F.col("_bad"), F.array(F.lit("not a result object"))).otherwise(
        F.concat("_types", result_violations(confidence_field))
    )
    empty = F.array().cast("array<string>")
    return (
        rows.withColumn("violations", found)
        .withColumn("hypothesis_assessments", F.coalesce("hypothesis_assessments", rows_empty(confidence_field)))
        .withColumn("additional_facts", F.coalesce("additional_facts", empty))
        .withColumn("root_cause_evidence", F.coalesce("root_cause_evidence", empty))
        .withColumn("undetermined", F.coalesce("undetermined", empty))
        .withColumn("planning_path_reason", F.coalesce("planning_path_reason", F.lit("")))
        .drop("_bad", "_types")
    )


def rows_empty(confidence_field: str):
    return F.array().cast(
        f"array<struct<statement:string,{confidence_field}:double,verdict:string,evidence:array<string>>>"
    )
