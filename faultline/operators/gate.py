"""Investigation results: validation, authorization, match with packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions import documents as doc
from faultline.functions.text import is_blank

# Name of the confidence each assessed hypothesis came with; producers call it
# differently, so it is a setting of every function here.
CONFIDENCE_FIELD = "prior_confidence"


def result_schema(confidence_field: str = CONFIDENCE_FIELD) -> str:
    return (
        "incident_id string, "
        f"hypothesis_assessments array<struct<statement:string,{confidence_field}:double,"
        "verdict:string,evidence:array<string>>>, additional_facts array<string>, "
        "validated_root_cause string, root_cause_evidence array<string>, planning_path string, "
        "planning_path_reason string, undetermined array<string>"
    )


def result_violations(confidence_field: str = CONFIDENCE_FIELD) -> Column:
    """What makes a result row unusable, empty if nothing."""
    def none_such(rule) -> Column:
        return F.coalesce(F.exists("hypothesis_assessments", lambda item: ~F.coalesce(rule(item), F.lit(False))), F.lit(False))

    return F.array_compact(F.array(
        F.when(F.col("incident_id").isNull(), F.lit("missing: incident_id")),
        F.when(F.col("planning_path").isNull(), F.lit("missing: planning_path")),
        F.when(~F.col("planning_path").isin(*fv.PLANNING_PATHS), F.lit("not in domain: planning_path")),
        F.when(none_such(lambda item: item["verdict"].isin(*fv.VERDICTS)), F.lit("not in domain: verdict")),
        F.when(
            none_such(lambda item: item[confidence_field].between(0.0, 1.0)),
            F.lit(f"not in [0, 1]: {confidence_field}"),
        ),
        F.when(none_such(lambda item: item["statement"].isNotNull()), F.lit("missing: statement")),
    ))


def document_violations(document: Column, confidence_field: str = CONFIDENCE_FIELD) -> Column:
    """What is wrong with the JSON types of a result document, before any cast; empty if nothing.

    Texts must be JSON strings (``validated_root_cause`` may be null), lists must be lists of their kind and are
    never null, assessments objects with a text, a verdict, a number and a list of texts. Absent lists and
    an absent reason are empty.
    """
    def field(name: str) -> Column:
        return F.try_variant_get(document, f"$.{name}", "variant")

    def absent(name: str) -> Column:
        return ~F.array_contains(F.map_keys(document.try_cast("map<string,variant>")), name)

    def null(value: Column) -> Column:
        return value.isNull() | F.is_variant_null(value)

    def texts(value: Column) -> Column:
        return F.coalesce(F.forall(value.try_cast("array<variant>"), lambda item: doc.is_string(item)), F.lit(False))

    def part(item: Column, name: str) -> Column:
        return F.try_variant_get(item, f"$.{name}", "variant")

    def assessment(item: Column) -> Column:
        evidence = part(item, "evidence")
        number = F.coalesce(F.schema_of_variant(part(item, confidence_field)).rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"), F.lit(False))
        return doc.is_string(part(item, "statement")) & doc.is_string(part(item, "verdict")) & number & (
            evidence.isNull() | texts(evidence))

    items = field("hypothesis_assessments").try_cast("array<variant>")
    cause = field("validated_root_cause")
    checks = [
        F.when(~doc.is_string(field(name)) & ~null(field(name)), F.lit(f"not a string: {name}"))
        for name in ("incident_id", "planning_path")
    ]
    checks += [
        F.when(~doc.is_string(cause) & ~null(cause), F.lit("not a string: validated_root_cause")),
        F.when(~absent("planning_path_reason") & ~doc.is_string(field("planning_path_reason")), F.lit("not a string: planning_path_reason")),
        F.when(~absent("hypothesis_assessments") & ~F.coalesce(F.forall(items, assessment), F.lit(False)),
               F.lit("not a list of assessments: hypothesis_assessments")),
    ]
    checks += [
        F.when(~absent(name) & ~texts(field(name)), F.lit(f"not a list of strings: {name}"))
        for name in ("additional_facts", "root_cause_evidence", "undetermined")
    ]
    return F.array_compact(F.array(*checks))


def with_decision(results: DataFrame) -> DataFrame:
    """Add ``authorized`` and ``reason``; the first failing condition gives the reason.

    The confidence of a hypothesis plays no part. Rows with ``violations`` (where there is such a column)
    are never authorized.
    """
    supported = F.coalesce(
        F.exists(
            "hypothesis_assessments",
            lambda item: F.coalesce(item["verdict"].isin(*fv.SUPPORTING_VERDICTS), F.lit(False)),
        ),
        F.lit(False),
    )
    undecided = F.coalesce(F.col("planning_path") == "undetermined", F.lit(True))
    reason = (
        F.when(is_blank(F.col("validated_root_cause")), fv.REASON_NO_CAUSE)
        .when(~supported, fv.REASON_NO_VERDICT)
        .when(undecided, fv.REASON_UNDETERMINED)
        .otherwise(fv.REASON_AUTHORIZED)
    )
    sound = F.size("violations") == 0 if "violations" in results.columns else F.lit(True)
    return results.withColumn("reason", reason).withColumn(
        "authorized", (F.col("reason") == fv.REASON_AUTHORIZED) & sound
    )


def match(packages: DataFrame, results: DataFrame) -> DataFrame:
    """Every package or result id: ``matched``, or which side is missing."""
    left = packages.select("incident_id", F.lit(True).alias("has_package"))
    right = results.select("incident_id", F.lit(True).alias("has_result"))
    joined = left.join(right, "incident_id", "full")
    state = (
        F.when(F.col("has_result").isNull(), "no_result")
        .when(F.col("has_package").isNull(), "no_package")
        .otherwise("matched")
    )
    return joined.select("incident_id", state.alias("match"))
