"""Evidence packages: one nested row per incident, and its JSON and text forms.

Facts, timeline and cluster come from the incident and its trigger event only;
summary, symptoms and hypotheses also from an analysis row if there is one.
Times are ISO texts here, since the JSON form must keep the source's offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions import keys
from faultline.functions.text import is_empty
from faultline.functions.timestamps import utc_iso
from faultline.operators.analysis import ANALYSIS_SCHEMA

_EVIDENCE = "struct<log_query_or_reference:string,timestamp:string,count:bigint>"
_HYPOTHESES = "array<struct<statement:string,confidence:double,supporting_correlations:array<string>>>"
_CORRELATED = "array<struct<description:string,timestamp:string,source:string>>"


def json_time(iso: Column) -> Column:
    """ISO text as it stands in JSON documents: UTC is written ``Z``."""
    return F.regexp_replace(iso, r"\+00:00$", "Z")


def _present(text: Column) -> Column:
    return ~is_empty(text)


def summary_text() -> Column:
    component = F.regexp_replace(F.coalesce("affected_component", F.lit("")), "^/+|/+$", "")
    phrase = F.when(component == "", F.lit("")).otherwise(F.concat(component, F.lit(" ")))
    kind = F.when(_present(F.col("trigger.error_type")), F.col("trigger.error_type")).otherwise(
        F.lit("an unspecified error")
    )
    title = F.concat(
        F.col("service"), F.lit(" "), phrase, F.lit("requests are failing with "), kind, F.lit(".")
    )
    return F.when(
        _present(F.col("analysis.summary")), F.concat(title, F.lit(" "), F.col("analysis.summary"))
    ).otherwise(title)


def impact() -> Column:
    return F.struct(
        F.col("analysis.impact_description").alias("description"),
        F.lit("occurrence_count").alias("metric"),
        F.col("error_cluster.count").cast("string").alias("value"),
    )


def package_cluster() -> Column:
    cluster = F.col("error_cluster")
    return F.struct(
        cluster["signature"].alias("signature"),
        cluster["count"].alias("count"),
        json_time(cluster["first_seen_iso"]).alias("first_seen"),
        json_time(cluster["last_seen_iso"]).alias("last_seen"),
        cluster["sample_message"].alias("sample_message"),
        keys.business_severity(cluster["severity"]).alias("severity"),
    )


def _evidence(reference: Column | None = None, iso: Column | None = None, count: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        (none if reference is None else reference).cast("string").alias("log_query_or_reference"),
        (none.cast("string") if iso is None else json_time(iso)).alias("timestamp"),
        (none if count is None else count).cast("bigint").alias("count"),
    ).cast(_EVIDENCE)


def _fact(statement: Column, *evidence: Column) -> Column:
    return F.struct(statement.alias("statement"), F.array(*evidence).alias("evidence"))


def observed_facts() -> Column:
    """Two facts always, three more where the evidence holds them; in this order."""
    cluster, event = F.col("error_cluster"), F.col("trigger")
    label = F.when(_present(event["error_type"]), event["error_type"]).otherwise(F.lit("This error"))
    place = F.when(
        _present(F.col("environment")), F.concat(F.lit(" ("), F.col("environment"), F.lit(")"))
    ).otherwise(F.lit(""))
    count = F.concat(
        label, F.lit(" occurred "), cluster["count"].cast("string"), F.lit(" time(s) in service '"),
        F.col("service"), F.lit("'"), place,
    )
    seen = F.concat(
        F.lit("First observed at "), cluster["first_seen_iso"],
        F.lit(", most recently at "), cluster["last_seen_iso"], F.lit("."),
    )
    status = F.when(
        event["http_status"].isNotNull(), F.concat(F.lit(" (HTTP "), event["http_status"], F.lit(")"))
    ).otherwise(F.lit(""))
    affected = F.concat(
        F.lit("Requests to '"), F.col("affected_component"), F.lit("' were affected"), status, F.lit(".")
    )
    message = F.concat(F.lit("The error message was: "), event["error_message"])
    request = F.concat(
        F.lit("At least one occurrence was recorded under request_id '"), event["request_id"], F.lit("'.")
    )
    own = _evidence(event["raw_ref"], event["ts_iso"])
    return F.array_compact(F.array(
        _fact(count, _evidence(event["raw_ref"], cluster["last_seen_iso"], cluster["count"])),
        _fact(seen, _evidence(iso=cluster["first_seen_iso"]), _evidence(iso=cluster["last_seen_iso"])),
        F.when(_present(F.col("affected_component")), _fact(affected, own)),
        F.when(_present(event["error_message"]), _fact(message, own)),
        F.when(_present(event["request_id"]), _fact(request, own)),
    ))


def timeline(detector: str) -> Column:
    """First and last occurrence and detection, by time; equal times keep this order."""
    cluster = F.col("error_cluster")

    def entry(ts: Column, position: int, iso: Column, text: str) -> Column:
        return F.struct(
            ts.alias("at"), F.lit(position).alias("position"), json_time(iso).alias("timestamp"),
            F.lit(text).alias("event"),
        )

    entries = F.array_compact(F.array(
        entry(cluster["first_seen"], 1, cluster["first_seen_iso"], "First occurrence observed"),
        F.when(
            cluster["last_seen"] != cluster["first_seen"],
            entry(cluster["last_seen"], 2, cluster["last_seen_iso"], "Most recent occurrence observed"),
        ),
        entry(F.col("detected_at"), 3, F.col("detected_at_iso"), f"{detector} detected this as an incident"),
    ))
    return F.transform(
        F.array_sort(entries),
        lambda item: F.struct(item["timestamp"].alias("timestamp"), item["event"].alias("event")),
    )


def top_hypothesis(hypotheses: Column) -> Column:
    """The hypothesis of largest confidence, the earliest among equals; NULL if none."""
    return F.reduce(
        hypotheses, F.try_element_at(hypotheses, F.lit(1)),
        lambda best, item: F.when(item["confidence"] > best["confidence"], item).otherwise(best),
    )


def with_analysis(incidents: DataFrame, analyses: DataFrame | None) -> DataFrame:
    """Left join: an incident without analysis stays, with ``analysis`` NULL."""
    columns = [part.split(" ", 1) for part in ANALYSIS_SCHEMA.split(", ")]
    names = [name for name, _ in columns if name != "incident_id"]
    if analyses is None:
        empty = "struct<" + ",".join(f"{n}:{t}" for n, t in columns if n != "incident_id") + ">"
        return incidents.withColumn("analysis", F.lit(None).cast(empty))
    rows = analyses.withColumn("hypotheses", _typed_hypotheses(analyses)).select(
        "incident_id", F.struct(*names).alias("analysis")
    )
    return incidents.join(rows, "incident_id", "left")


def _typed_hypotheses(analyses: DataFrame) -> Column:
    has_support = "supporting_correlations" in analyses.schema["hypotheses"].dataType.elementType.fieldNames()
    return F.transform(
        "hypotheses",
        lambda item: F.struct(
            item["statement"].alias("statement"),
            item["confidence"].cast("double").alias("confidence"),
            (
                item["supporting_correlations"] if has_support
                else F.lit(None).cast("array<string>")
            ).alias("supporting_correlations"),
        ),
    )


def build_packages(
    incidents: DataFrame, analyses: DataFrame | None = None, detector: str = "Detector"
) -> DataFrame:
    """Package columns of every incident. ``detector`` names us in the timeline."""
    no_text = F.array().cast("array<string>")
    rows = with_analysis(incidents, analyses)
    iso = F.when(F.col("detected_at") == F.col("trigger.ts"), F.col("trigger.ts_iso")).otherwise(
        utc_iso(F.col("detected_at"))
    )
    rows = rows.withColumn("detected_at_iso", iso).withColumn(
        "top", top_hypothesis(F.col("analysis.hypotheses"))
    )
    reference = F.col("trigger.raw_ref")
    return rows.select(
        "incident_id",
        F.lit(fv.PACKAGE_VERSION).alias("schema_version"),
        "severity",
        json_time(F.col("detected_at_iso")).alias("detected_at"),
        "environment", "service", "affected_component",
        impact().alias("impact"),
        summary_text().alias("summary"),
        F.coalesce("analysis.symptoms", no_text).alias("symptoms"),
        F.array(package_cluster()).alias("error_clusters"),
        observed_facts().alias("observed_facts"),
        F.array().cast(_CORRELATED).alias("correlated_events"),
        timeline(detector).alias("timeline"),
        F.coalesce("analysis.hypotheses", F.array().cast(_HYPOTHESES)).alias("hypotheses"),
        F.col("top.statement").alias("suspected_root_cause"),
        F.coalesce("top.confidence", F.lit(0.0)).alias("confidence_overall"),
        F.when(
            _present(F.col("trigger.version")),
            F.struct(
                F.col("trigger.version").alias("version"),
                F.lit(None).cast("string").alias("deployed_at"),
                F.lit(None).cast("string").alias("commit"),
            ),
        ).alias("deployment_information"),
        F.lit(None).cast("string").alias("relevant_commit"),
        no_text.alias("relevant_files"),
        no_text.alias("documentation_context"),
        F.coalesce("analysis.recommended_investigation", no_text).alias("recommended_investigation"),
        F.when(_present(reference), F.array(reference)).otherwise(no_text).alias("log_references"),
        no_text.alias("related_incident_ids"),
    )


def with_correlations(packages: DataFrame, changes: DataFrame) -> DataFrame:
    """Fill ``correlated_events`` with all ``changes(incident_id, change_id, ts)``, earliest first."""
    item = F.struct(
        "ts", "change_id",
        F.struct(
            F.concat(F.lit("change "), F.col("change_id").cast("string")).alias("description"),
            json_time(utc_iso(F.col("ts"))).alias("timestamp"),
            F.lit("change log").alias("source"),
        ).alias("event"),
    )
    named = changes.groupBy("incident_id").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["event"]).alias("_events"))
    return (
        packages.join(named, "incident_id", "left")
        .withColumn("correlated_events", F.coalesce("_events", "correlated_events"))
        .select(*packages.columns)
    )


def package_json(packages: DataFrame) -> DataFrame:
    """``incident_id, package``: the JSON form, where absent values are left out."""
    return packages.select(
        "incident_id", F.to_json(F.struct(*fv.PACKAGE_FIELDS)).alias("package")
    )


def report_text(packages: DataFrame) -> DataFrame:
    """``incident_id, report``: the short text a person reads."""
    top = top_hypothesis(F.col("hypotheses"))
    count = F.coalesce(F.try_element_at("error_clusters", F.lit(1))["count"], F.lit(0))
    steps = F.when(
        F.size("recommended_investigation") > 0,
        F.concat(
            F.lit("\n\n[RECOMMENDED INVESTIGATION]"),
            F.array_join(
                F.transform("recommended_investigation", lambda step: F.concat(F.lit("\n- "), step)), ""
            ),
        ),
    ).otherwise(F.lit(""))
    text = F.concat(
        F.lit("[INCIDENT]\n"), F.col("summary"),
        F.lit("\nSeverity: "), F.col("severity"),
        F.lit("\nOccurrences: "), count.cast("string"),
        F.lit("\n\n[HYPOTHESIS]\n"),
        F.coalesce(top["statement"], F.lit("(none -- insufficient evidence)")),
        F.lit("\n\n[CONFIDENCE]\n"), F.format_string("%.2f", "confidence_overall"), steps,
    )
    return packages.select("incident_id", text.alias("report"))
