"""ISO-8601 timestamps: what counts as one, its instant, and its exact text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual form; everything else that is still ISO-8601 goes the slow way.
_USUAL = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}:\d{2})?$"
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{8})"
_CLOCK = r"(?:\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{4}(?:\d{2}(?:[.,]\d+)?)?)"
_ZONE = r"(?:[+-]\d{2}(?::?\d{2})?)?"
_ACCEPTED = rf"(?s)^{_DATE}(?:.{_CLOCK}{_ZONE})?$"
_PARTS = (
    r"(?s)^(\d{4})-?(\d{2})-?(\d{2})(?:.(\d{2}):?(\d{2})?:?(\d{2})?(?:[.,](\d+))?"
    r"(?:([+-]\d{2}):?(\d{2})?)?)?$"
)


def canonical_timestamp(text: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS[.digits][+HH:MM]`` of an ISO-8601 text, else NULL.

    Every ``Z`` is read as ``+00:00``. Week dates, zones with seconds and bare
    years, months or times are not accepted.
    """
    offset = F.replace(text, F.lit("Z"), F.lit("+00:00"))

    def part(group: int, default: str) -> Column:
        found = F.regexp_extract(offset, _PARTS, group)
        return F.when(found == "", F.lit(default)).otherwise(found)

    fraction = F.regexp_extract(offset, _PARTS, 7)
    zone = F.regexp_extract(offset, _PARTS, 8)
    rebuilt = F.concat(
        part(1, ""), F.lit("-"), part(2, ""), F.lit("-"), part(3, ""), F.lit("T"),
        part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"),
        F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.when(zone == "", F.lit("")).otherwise(F.concat(zone, F.lit(":"), part(9, "00"))),
    )
    return F.when(offset.rlike(_USUAL), offset).when(offset.rlike(_ACCEPTED), rebuilt)


def instant(canonical: Column) -> Column:
    """TIMESTAMP of a canonical text, NULL if the date or time does not exist.

    A text without zone is read as UTC.
    """
    return canonical.try_cast("timestamp")


def iso_text(canonical: Column) -> Column:
    """The text with ``T``, six fraction digits (none when zero) and the source's offset."""
    micros = F.rpad(F.left(F.regexp_extract(canonical, r"\.(\d+)", 1), F.lit(6)), 6, "0")
    zone = F.regexp_extract(canonical, r"([+-]\d{2}:\d{2})$", 1)
    return F.concat(
        F.left(canonical, F.lit(10)), F.lit("T"), F.substring(canonical, 12, 8),
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
        F.when(zone == "-00:00", F.lit("+00:00")).otherwise(zone),
    )


def utc_iso(ts: Column) -> Column:
    """ISO text of a TIMESTAMP in UTC, for inputs that never had a text."""
    return iso_text(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))
