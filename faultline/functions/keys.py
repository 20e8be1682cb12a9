"""Identity, signature, incident id, severities and credential names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions.documents import is_falsy, text_of
from faultline.functions.text import message_template, or_unknown, top_frame

_CREDENTIAL = "|".join(fv.CREDENTIAL_WORDS)


def is_credential_name(key: Column) -> Column:
    return F.lower(key).rlike(_CREDENTIAL)


def drop_credentials(fields: Column) -> Column:
    """Map without the keys whose name contains a credential word."""
    return F.map_filter(fields, lambda key, _: ~is_credential_name(key))


def event_identity(value: Callable[[str], Column], plain: Callable[[str], Column]) -> Column:
    """``event_id``, else ``insertId``, else a hash of five raw fields.

    ``value`` and ``plain`` give a raw field and its text by name. An absent
    field counts as empty text, a JSON null as ``None``, so the parts are joined
    by ``concat``: ``concat_ws`` would skip NULLs.
    """
    def text(name: str) -> Column:
        return text_of(value(name), plain(name))

    parts: list[Column] = []
    for name in fv.IDENTITY_FIELDS:
        parts += [F.lit("|"), F.coalesce(text(name), F.lit(""))]
    return (
        F.when(~is_falsy(value("event_id"), plain("event_id")), text("event_id"))
        .when(~is_falsy(value("insertId"), plain("insertId")), text("insertId"))
        .otherwise(F.sha2(F.concat(*parts[1:]), 256))
    )


def error_signature(
    environment: Column, service: Column, error_type: Column,
    stack_trace: Column, message: Column, endpoint: Column,
) -> Column:
    """Cluster key. ``endpoint`` is NULL only where the event names none."""
    return F.concat(
        or_unknown(environment), F.lit(":"), service, F.lit(":"), or_unknown(error_type), F.lit(":"),
        top_frame(stack_trace), F.lit(":"), message_template(message), F.lit(":"),
        F.coalesce(endpoint, F.lit(fv.UNKNOWN)),
    )


def is_clustered(severity: Column) -> Column:
    return severity.isin(*fv.CLUSTERED_SEVERITIES)


def business_severity(severity: Column) -> Column:
    branches = None
    for level, impact in fv.BUSINESS_SEVERITY.items():
        branches = (F if branches is None else branches).when(severity == level, F.lit(impact))
    return branches


def incident_threshold(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", F.lit(fv.CRITICAL_THRESHOLD)).otherwise(
        F.lit(fv.ERROR_THRESHOLD)
    )


def incident_id(signature: Column, first_seen_iso: Column) -> Column:
    return F.substring(F.sha2(F.concat(signature, F.lit("|"), first_seen_iso), 256), 1, 16)
