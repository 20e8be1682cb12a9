"""Raw payloads to typed, sanitized events with one disposition per row.

Input: ``seq, payload, source``. Output: the same ``seq``, a ``status`` with
the ``error`` text, and the event columns (NULL unless ``status = 'ok'``).
Only built-in expressions; no shuffle. Write the result before using it more
than once, since every read of an unwritten result parses the payload again.
Name the event columns that are needed: the optimizer drops nothing that sits
behind a generator, so the others are left out while the plan is built.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import partial
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions import documents as doc
from faultline.functions import keys
from faultline.functions import timestamps as tm
from faultline.functions.once import with_computed
from faultline.functions.text import REDACTED, redact
from faultline.sources.mappings import RecordLayout

Layouts = Mapping[str, RecordLayout]
NO_LAYOUTS: Layouts = MappingProxyType({})

OK = "ok"
DUPLICATE = "duplicate"
MALFORMED = "malformed_json"
INVALID = "invalid_schema"
WRONG_TYPE = "invalid_type"
UNSUPPORTED = "unsupported_source"

EVENT_COLUMNS = (
    "event_id", "ts", "ts_iso", "severity", "service", "environment", "version", "message",
    "error_type", "error_message", "stack_trace", "request_id", "trace_id", "span_id",
    "source", "raw_ref", "metadata", "endpoint", "http_status", "signature",
)


def _quoted(text: Column) -> Column:
    mark = F.when(text.contains("'") & ~text.contains('"'), F.lit('"')).otherwise(F.lit("'"))
    return F.concat(mark, text, mark)


_READ_FIELDS = (*fv.NAMED_FIELDS, "insertId")


def _value(name: str) -> Column:
    return F.try_variant_get("document", f"$.{name}", "variant")


def _plain(name: str) -> Column:
    return F.col(f"plain_{name}")


def _read_fields() -> Column:
    """The named fields' texts in one walk over the document; NULL unless an object."""
    shape = ", ".join(f"`{name}`: string" for name in _READ_FIELDS)
    return F.try_variant_get("document", "$", f"struct<{shape}>")


def _missing_fields() -> Column:
    """Names of required fields without a value, as one text."""
    return F.concat_ws(", ", *[
        F.when(doc.is_falsy(_value(name), _plain(name)), F.lit(name)) for name in fv.REQUIRED_FIELDS
    ])


def _wrong_types() -> Column:
    """Names of text fields that hold something else (JSON null is fine if optional), as one text."""
    def foreign(name: str) -> Column:
        return ~doc.is_string(_value(name), _plain(name))

    required = [F.when(foreign(name), F.lit(name)) for name in ("service", "message")]
    optional = [
        F.when(_plain(name).isNotNull() & foreign(name), F.lit(name)) for name in fv.OPTIONAL_TEXT_FIELDS
    ]
    truthy = ~doc.is_falsy(_value("raw_ref"), _plain("raw_ref"))
    reference = F.when(truthy & foreign("raw_ref"), F.lit("raw_ref"))
    return F.concat_ws(", ", *required, *optional, reference)


def _disposition(sources: Iterable[str]) -> tuple[Column, Column]:
    no_document = ~F.col("is_json")
    no_object = F.col("document").isNull()
    missing = F.col("missing") != ""
    bad_severity = ~F.coalesce(
        doc.is_string(_value("severity"), _plain("severity"))
        & F.col("severity_text").isin(*fv.LOG_SEVERITIES), F.lit(False)
    )
    bad_time = F.col("event_ts").isNull()
    foreign = ~F.col("source").isin("local", *sources)
    wrong = F.col("wrong") != ""
    status = (
        F.when(no_document, MALFORMED)
        .when(no_object | missing | bad_severity | bad_time, INVALID)
        .when(foreign, UNSUPPORTED)
        .when(wrong, WRONG_TYPE)
        .otherwise(OK)
    )
    error = (
        F.when(no_document, "payload is not valid JSON")
        .when(no_object, "payload is not a JSON object")
        .when(missing, F.concat(F.lit("missing required field(s): "), F.col("missing")))
        .when(bad_severity, F.concat(F.lit("invalid severity: "), _quoted(F.col("severity_text"))))
        .when(bad_time, F.concat(F.lit("invalid timestamp: "), _quoted(F.col("time_text"))))
        .when(foreign, F.concat(F.lit("unsupported source: "), F.col("source")))
        .when(wrong, F.concat(F.lit("not a string: "), F.col("wrong")))
    )
    return status, error


def parse(raw: DataFrame, layouts: Layouts = NO_LAYOUTS) -> DataFrame:
    """Add ``is_json`` and ``document`` (VARIANT, NULL unless an object).

    Records of a source that ``layouts`` names come out in the library's own layout.
    """
    sealed = raw.withColumn("sealed", doc.sealed_document(F.col("payload")))
    opened = sealed.withColumn("_document", doc.unsealed_document(F.col("sealed"), F.col("payload")))
    # A valid JSON text is an object exactly if it begins with a brace.
    is_object = F.col("payload").rlike(r"^[ \t\r\n]*\{")
    parsed = with_computed(
        opened.drop("sealed"),
        F.col("_document").isNotNull().alias("is_json"),
        F.when(is_object, F.col("_document")).alias("document"),
    ).drop("_document")
    if not layouts:
        return parsed
    # one step after the other: a step's columns are computed once, whatever the next one builds on them
    steps = {"read": ("document",), "found": ("read",), "fields": ("read", "found"), "document": ("read", "fields")}
    rows, made = parsed, []
    for step, given in steps.items():
        columns = []
        for at, (source, layout) in enumerate(layouts.items()):
            theirs = (F.col("source") == source) & F.col("document").isNotNull()
            parts = [F.col(name if name == "document" else f"_{name}_{at}") for name in given]
            columns.append(F.when(theirs, getattr(layout, step)(*parts)).alias(f"_{step}_{at}"))
            made.append(f"_{step}_{at}")
        rows = with_computed(rows, *columns)
    own = F.coalesce(*[f"_document_{at}" for at in range(len(layouts))], "document")
    return rows.withColumn("document", own).drop(*made)


def validate(parsed: DataFrame, layouts: Layouts = NO_LAYOUTS) -> DataFrame:
    """Add ``status`` and ``error`` of each parsed row, plus its parsed time."""
    read = with_computed(parsed, _read_fields().alias("plain"))
    read = read.select(*parsed.columns, *[F.col("plain")[name].alias(f"plain_{name}") for name in _READ_FIELDS])
    texts = with_computed(
        read,
        doc.text_of(_value("timestamp"), _plain("timestamp")).alias("time_text"),
        doc.text_of(_value("severity"), _plain("severity")).alias("severity_text"),
        _missing_fields().alias("missing"),
        _wrong_types().alias("wrong"),
    )
    timed = with_computed(texts, tm.canonical_timestamp(F.col("time_text")).alias("time"))
    timed = timed.withColumn("event_ts", tm.instant(F.col("time")))
    status, error = _disposition(layouts)
    return with_computed(timed, status.alias("status"), error.alias("error"))


def sanitized_metadata(fields: Column, deep: bool = False) -> Column:
    """Everything that is no named field, without credential-named keys.

    ``deep`` also cleans the first level of a nested ``metadata`` object, which
    the plain rule leaves as it is.
    """
    clean = F.map_filter(
        fields, lambda key, _: ~(key.isin(*fv.NAMED_FIELDS) | keys.is_credential_name(key))
    )
    if not deep:
        return clean

    def inner(key: Column, value: Column) -> Column:
        nested = value.try_cast("map<string,variant>")
        cleaned = F.to_variant_object(keys.drop_credentials(nested))
        return F.when((key == "metadata") & nested.isNotNull(), cleaned).otherwise(value)

    return F.transform_values(clean, inner)


def _redacted_value(value: Column) -> Column:
    """One metadata value with secret-shaped texts replaced at any depth; any other stays as it is, NULL too."""
    plain, text = doc.plain_text(value), F.to_json(value)
    nested = redact(text, json=True)
    parsed = F.when(nested == text, value).otherwise(
        F.coalesce(F.try_parse_json(nested), F.lit(REDACTED).cast("variant")))
    return F.when(doc.is_string(value, plain), redact(plain).cast("variant")).when(value.isNotNull(), parsed)


_FREE_TEXT = ("message", "error_message", "stack_trace")
# event columns that are derived from others
_DERIVED = {
    "raw_ref": ("event_id", "reference"), "endpoint": ("endpoint_value",), "http_status": ("http_status_value",),
    "signature": ("environment", "service", "severity", "error_type", "stack_trace", "message", "endpoint_value"),
}


def normalize(
    checked: DataFrame, deep: bool = True, redacting: bool = True, columns: Sequence[str] = EVENT_COLUMNS
) -> DataFrame:
    """Event columns of every row that passed; NULL in the others.

    ``redacting`` replaces secret-shaped values in free text and metadata before anything is derived from
    them (identity hashes excepted); the payload keeps what came in. Without it and ``deep`` values stay.
    ``columns`` names the event columns to build, in this order; ``source`` is one of them.
    """
    unknown = set(columns) - set(EVENT_COLUMNS)
    if unknown:
        raise ValueError(f"no event columns: {sorted(unknown)}")
    good = F.col("status") == OK

    def text(name: str) -> Column:
        plain = _plain(name)
        return F.when(good, redact(plain) if redacting and name in _FREE_TEXT else plain)

    def other(name: str) -> Column:
        # a metadata value by itself, without the map it stands in
        return F.when(good, _redacted_value(_value(name)) if redacting else _value(name))

    def metadata() -> Column:
        fields = sanitized_metadata(doc.object_fields(F.col("document")), deep)
        return F.transform_values(fields, lambda _, value: _redacted_value(value)) if redacting else fields

    makers = {
        "event_id": lambda: F.when(good, keys.event_identity(_value, _plain)),
        "ts": lambda: F.when(good, F.col("event_ts")),
        "ts_iso": lambda: F.when(good, tm.iso_text(F.col("time"))),
        **{name: partial(text, name) for name in ("severity", "service", "message", *fv.OPTIONAL_TEXT_FIELDS)},
        "reference": lambda: F.when(good & ~doc.is_falsy(_value("raw_ref"), _plain("raw_ref")), _plain("raw_ref")),
        "endpoint_value": lambda: other("endpoint"),
        "http_status_value": lambda: other("http_status"),
        "metadata": lambda: F.when(good, metadata()),
    }
    derived = [name for name in columns if name in _DERIVED]
    first = {name for name in columns if name in makers} | {part for name in derived for part in _DERIVED[name]}
    staged = with_computed(
        checked, *[make().alias(f"_{name}") for name, make in makers.items() if name in first])

    def value_text(name: str) -> Column:
        value = F.col(f"_{name}_value")
        return F.when(F.is_variant_null(value), F.lit(None).cast("string")).otherwise(doc.text_of(value))

    finishers = {
        "raw_ref": lambda: F.coalesce("_reference", "_event_id"),
        "endpoint": lambda: value_text("endpoint"),
        "http_status": lambda: value_text("http_status"),
        "signature": lambda: F.when(keys.is_clustered(F.col("_severity")), keys.error_signature(
            F.col("_environment"), F.col("_service"), F.col("_error_type"), F.col("_stack_trace"),
            F.col("_message"), doc.text_of(F.col("_endpoint_value")))),
    }
    if derived:
        staged = with_computed(staged, *[finishers[name]().alias(f"_{name}") for name in derived])
    return staged.select(
        "seq", "payload", "status", "error",
        *[F.col(name if name == "source" else f"_{name}").alias(name) for name in columns])


def ingest(
    raw: DataFrame, deep: bool = True, redacting: bool = True, columns: Sequence[str] = EVENT_COLUMNS,
    layouts: Layouts = NO_LAYOUTS,
) -> DataFrame:
    """Parse, validate, normalize and sanitize raw rows in one projection.

    ``columns`` as in ``normalize``. ``layouts`` gives the record layout of each source beside ``local``; rows of
    any other source are quarantined.
    """
    return normalize(validate(parse(raw, layouts), layouts), deep, redacting, columns)


def accepted(ingested: DataFrame) -> DataFrame:
    """Rows that became events, as event columns with their ``seq``."""
    return ingested.filter(F.col("status") == OK).select("seq", *EVENT_COLUMNS)


def quarantine(ingested: DataFrame) -> DataFrame:
    """Rows that did not, with payload and reason."""
    return ingested.filter(F.col("status") != OK).select("seq", "payload", "source", "status", "error")
