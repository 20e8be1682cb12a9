"""Input and output of the analysis step; the model call itself is outside.

``prompts`` is the table a batch-inference job reads; ``parse_responses``
checks what came back. An incident never depends on either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions import documents as doc
from faultline.functions import keys
from faultline.functions.once import with_computed
from faultline.functions.text import is_empty, truncate_head, truncate_tail

ANALYSIS_SCHEMA = (
    "incident_id string, summary string, impact_description string, symptoms array<string>, "
    "observed_facts array<string>, "
    "hypotheses array<struct<statement:string,confidence:double,supporting_correlations:array<string>>>, "
    "recommended_investigation array<string>"
)


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def sorted_json(fields: Column) -> Column:
    """JSON of a MAP<STRING, VARIANT> with its keys in order, credentials removed."""
    clean = keys.drop_credentials(fields)
    entries = F.transform(F.sort_array(F.map_keys(clean)), lambda key: F.struct(key, clean[key]))
    return F.coalesce(F.to_json(F.map_from_entries(entries)), F.lit("{}"))


def prompt_text(metadata: Column, heading: str) -> Column:
    """Bounded text of an incident and its trigger event, one labelled line each."""
    cluster, event = F.col("error_cluster"), F.col("trigger")
    trace = F.when(is_empty(event["stack_trace"]), F.lit("(none)")).otherwise(event["stack_trace"])
    lines = [
        (heading, None),
        ("service: ", F.col("service")),
        ("environment: ", F.col("environment")),
        ("affected_component: ", F.col("affected_component")),
        ("severity: ", F.col("severity")),
        ("signature: ", F.col("signature")),
        ("occurrence_count: ", cluster["count"]),
        ("first_seen: ", cluster["first_seen_iso"]),
        ("last_seen: ", cluster["last_seen_iso"]),
        ("sample_message: ", truncate_head(cluster["sample_message"], fv.MESSAGE_CHARS)),
        ("", None),
        ("Representative log event (one example occurrence):", None),
        ("timestamp: ", event["ts_iso"]),
        ("error_type: ", event["error_type"]),
        ("error_message: ", event["error_message"]),
        ("message: ", truncate_head(event["message"], fv.MESSAGE_CHARS)),
        ("request_id: ", event["request_id"]),
        ("trace_id: ", event["trace_id"]),
        ("version: ", event["version"]),
        ("metadata: ", metadata),
        ("stack_trace:\n", truncate_tail(trace, fv.STACK_TRACE_CHARS)),
    ]
    parts: list[Column] = []
    for label, value in lines:
        parts.append(F.lit(label))
        if value is not None:
            parts.append(_shown(value))
        parts.append(F.lit("\n"))
    return F.concat(*parts)


def prompts(
    incidents: DataFrame,
    analyzed: DataFrame | None = None,
    heading: str = "Incident evidence (deterministic):",
) -> DataFrame:
    """``incident_id, prompt`` of every incident ``analyzed`` does not hold yet."""
    waiting = incidents
    if analyzed is not None:
        waiting = incidents.join(analyzed.select("incident_id"), "incident_id", "left_anti")
    has_metadata = "metadata" in incidents.schema["trigger"].dataType.fieldNames()
    metadata = sorted_json(F.col("trigger.metadata")) if has_metadata else F.lit("{}")
    return waiting.select("incident_id", prompt_text(metadata, heading).alias("prompt"))


def responses_from(prompt_rows: DataFrame, infer: Callable) -> DataFrame:
    """Run a user's function over prompt batches: ``incident_id, response``.

    ``infer`` gets and returns an iterator of pandas frames (``mapInPandas``);
    clients, keys and retries are its own business.
    """
    return prompt_rows.mapInPandas(infer, "incident_id string, response string")


def _is_text_list(value: Column) -> Column:
    items = value.try_cast("array<variant>")
    return F.coalesce(F.forall(items, lambda item: doc.is_string(item)), F.lit(False))


def _number(value: Column) -> Column:
    numeric = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")
    return F.when(numeric, F.try_variant_get(value, "$", "double"))


def is_confidence(value: Column) -> Column:
    return F.coalesce(_number(value).between(0.0, 1.0), F.lit(False))


def _is_hypothesis(value: Column) -> Column:
    return doc.is_string(F.try_variant_get(value, "$.statement", "variant")) & is_confidence(
        F.try_variant_get(value, "$.confidence", "variant")
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Analysis columns of each response plus ``valid``; columns are NULL if not valid."""
    fields = F.col("_fields")
    hypotheses = fields["hypotheses"].try_cast("array<variant>")
    valid = (
        fields.isNotNull()
        & doc.is_string(fields["summary"]) & doc.is_string(fields["impact_description"])
        & _is_text_list(fields["symptoms"]) & _is_text_list(fields["observed_facts"])
        & _is_text_list(fields["recommended_investigation"])
        & F.coalesce(F.forall(hypotheses, _is_hypothesis), F.lit(False))
    )
    shape = ANALYSIS_SCHEMA.replace("incident_id string, ", "")
    shape = "struct<" + ",".join(part.replace(" ", ":", 1) for part in shape.split(", ")) + ">"
    opened = responses.withColumn("_sealed", doc.sealed_document(F.col("response"))).withColumn(
        "_document", doc.unsealed_document(F.col("_sealed"), F.col("response"))
    )
    opened = with_computed(opened, doc.object_fields(F.col("_document")).alias("_fields"))
    judged = with_computed(opened, F.coalesce(valid, F.lit(False)).alias("valid"))
    typed = F.when(F.col("valid"), F.try_variant_get("_document", "$", shape))
    return with_computed(judged, typed.alias("a")).select("incident_id", "valid", "a.*")


def valid_analyses(parsed: DataFrame) -> DataFrame:
    return parsed.filter("valid").drop("valid")
