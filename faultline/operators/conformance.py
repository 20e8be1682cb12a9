"""Checks of JSON package documents: each document with the list of its violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions import documents as doc
from faultline.functions.once import with_computed
from faultline.operators.analysis import is_confidence

_TEXT_FIELDS = (
    "incident_id", "schema_version", "severity", "detected_at", "environment", "service",
    "affected_component", "summary", "suspected_root_cause", "relevant_commit",
)
_TEXT_LISTS = (
    "symptoms", "relevant_files", "documentation_context", "recommended_investigation",
    "log_references", "related_incident_ids",
)
# Nested objects: (required keys, allowed keys). Fixed values.
_OBJECTS = {
    "impact": ((), ("description", "metric", "value")),
    "deployment_information": ((), ("version", "deployed_at", "commit")),
}
_OBJECT_LISTS = {
    "error_clusters": (
        ("signature", "count", "first_seen", "last_seen"),
        ("signature", "count", "first_seen", "last_seen", "sample_message", "severity"),
    ),
    "observed_facts": (("statement", "evidence"), ("statement", "evidence")),
    "correlated_events": (("description", "timestamp"), ("description", "timestamp", "source")),
    "timeline": (("timestamp", "event"), ("timestamp", "event")),
    "hypotheses": (
        ("statement", "confidence"), ("statement", "confidence", "supporting_correlations"),
    ),
}


# Types of nested fields; what is not named is text. Fixed values.
_WHOLE_NUMBERS = {("error_clusters", "count"), ("evidence", "count")}
_NUMBERS = {("hypotheses", "confidence")}
_TIMES = {
    ("error_clusters", "first_seen"), ("error_clusters", "last_seen"), ("correlated_events", "timestamp"),
    ("timeline", "timestamp"), ("evidence", "timestamp"), ("deployment_information", "deployed_at"),
}
_SCALES = {("error_clusters", "severity")}
_EVIDENCE = ("source", "log_query_or_reference", "timestamp", "count")
_DATE_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


def _is_time(value: Column) -> Column:
    text = doc.plain_text(value)
    real = F.try_to_timestamp(F.regexp_replace(text, r"[Tt ]([0-9:]{8}).*$", " $1"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return doc.is_string(value) & F.coalesce(text.rlike(_DATE_TIME) & real.isNotNull(), F.lit(False))


def _kind(value: Column, pattern: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(pattern), F.lit(False))


def _field_is_right(owner: str, name: str, value: Column) -> Column:
    if (owner, name) in _WHOLE_NUMBERS:
        return _kind(value, r"^BIGINT$")
    if (owner, name) in _NUMBERS:
        return _kind(value, r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")
    if (owner, name) in _TIMES:
        return _is_time(value)
    if (owner, name) in _SCALES:
        return doc.is_string(value) & doc.plain_text(value).isin(*fv.BUSINESS_SEVERITIES, *fv.LOG_SEVERITIES)
    if name == "supporting_correlations":
        return _list_of_text(value)
    if name == "evidence":
        return _list_is_right(value, "evidence", (), _EVIDENCE)
    return doc.is_string(value)


def _says(problem: Column, text: str) -> Column:
    return F.when(F.coalesce(problem, F.lit(False)), F.lit(text))


def _list_of_text(value: Column) -> Column:
    return F.coalesce(F.forall(value.try_cast("array<variant>"), lambda item: doc.is_string(item)), F.lit(False))


def _object_is_right(value: Column, owner: str, required: tuple, allowed: tuple) -> Column:
    fields = value.try_cast("map<string,variant>")
    keys = F.map_keys(fields)
    has_all = F.size(F.array_except(F.array(*[F.lit(k) for k in required]).cast("array<string>"), keys)) == 0
    no_more = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))) == 0
    right = has_all & no_more
    for name in allowed:
        item = F.try_variant_get(value, f"$.{name}", "variant")
        right = right & (~F.array_contains(keys, name) | _field_is_right(owner, name, item))
    return F.coalesce(right, F.lit(False))


def _list_is_right(value: Column, owner: str, required: tuple, allowed: tuple) -> Column:
    items = value.try_cast("array<variant>")
    return F.coalesce(
        F.forall(items, lambda item: _object_is_right(item, owner, required, allowed)), F.lit(False)
    )


def violations(fields: Column) -> Column:
    """ARRAY<STRING> of what is wrong with a package object, empty if nothing."""
    present = {name: fields[name].isNotNull() for name in fv.PACKAGE_FIELDS}
    checks = [_says(~present[name], f"missing: {name}") for name in fv.PACKAGE_REQUIRED]
    checks += [
        _says(present[name] & ~doc.is_string(fields[name]), f"not a string: {name}")
        for name in _TEXT_FIELDS
    ]
    checks += [
        _says(present[name] & ~_list_of_text(fields[name]), f"not a list of strings: {name}")
        for name in _TEXT_LISTS
    ]
    checks += [
        _says(present[name] & ~_object_is_right(fields[name], name, *rule), f"wrong object: {name}")
        for name, rule in _OBJECTS.items()
    ]
    checks += [
        _says(present[name] & ~_list_is_right(fields[name], name, *rule), f"wrong items: {name}")
        for name, rule in _OBJECT_LISTS.items()
    ]
    severity = F.try_variant_get(fields["severity"], "$", "string")
    version = F.try_variant_get(fields["schema_version"], "$", "string")
    hypotheses = fields["hypotheses"].try_cast("array<variant>")
    checks += [
        _says(doc.is_string(fields["severity"]) & ~severity.isin(*fv.BUSINESS_SEVERITIES), "not in scale: severity"),
        _says(doc.is_string(fields["schema_version"]) & (version != fv.PACKAGE_VERSION), "not 1.1: schema_version"),
        _says(
            present["confidence_overall"] & ~is_confidence(fields["confidence_overall"]),
            "not in [0, 1]: confidence_overall",
        ),
        _says(
            F.exists(hypotheses, lambda item: ~is_confidence(F.try_variant_get(item, "$.confidence", "variant"))),
            "not in [0, 1]: hypotheses.confidence",
        ),
    ]
    detected = fields["detected_at"]
    checks.append(_says(doc.is_string(detected) & ~_is_time(detected), "not a time: detected_at"))
    unknown = F.transform(
        F.array_sort(F.array_except(F.map_keys(fields), F.array(*[F.lit(k) for k in fv.PACKAGE_FIELDS]))),
        lambda key: F.concat(F.lit("unknown: "), key),
    )
    return F.concat(F.array_compact(F.array(*checks)), unknown)


def check_packages(documents: DataFrame, column: str = "package") -> DataFrame:
    """Input rows plus ``violations`` of the JSON text in ``column``."""
    opened = (
        documents.withColumn("_sealed", doc.sealed_document(F.col(column)))
        .withColumn("_document", doc.unsealed_document(F.col("_sealed"), F.col(column)))
    )
    opened = with_computed(opened, doc.object_fields(F.col("_document")).alias("_fields"))
    checked = F.when(F.col("_fields").isNull(), F.array(F.lit("not a JSON object"))).otherwise(
        violations(F.col("_fields"))
    )
    return with_computed(opened, checked.alias("violations")).drop("_sealed", "_document", "_fields")
