"""JSON documents as VARIANT: strict parse, truthiness, text rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sealed_document(payload: Column) -> Column:
    """VARIANT array ``[payload, hash of payload]``, NULL if that is no JSON.

    ``try_parse_json`` ignores what follows the first value, so a payload is
    parsed in front of its own hash: the hash comes back as item 1 exactly when
    the payload was one whole value.
    """
    seal = F.xxhash64(payload).cast("string")
    text = F.concat(F.lit("["), payload, F.lit(","), seal, F.lit("]"))
    return F.try_parse_json(F.when(F.is_valid_utf8(payload), text))


def unsealed_document(sealed: Column, payload: Column) -> Column:
    """The payload's VARIANT, NULL unless it was exactly one JSON value."""
    whole = F.try_variant_get(sealed, "$[1]", "bigint") == F.xxhash64(payload)
    alone = F.try_variant_get(sealed, "$[2]", "variant").isNull()
    return F.when(whole & alone, F.try_variant_get(sealed, "$[0]", "variant"))


def object_fields(document: Column) -> Column:
    """MAP<STRING, VARIANT> of a JSON object, NULL for any other value."""
    return document.try_cast("map<string,variant>")


# Texts that a number, boolean, array or object can print as; any other text
# of a value shows by itself that the value was a string.
_NOT_ONLY_STRING = r"(?s)^(-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|-?Infinity|NaN|[\[{].*)$"
_FALSY_TEXT = r"^(false|\[\]|\{\}|-?0+(\.0+)?([eE][+-]?\d+)?)$"


def plain_text(value: Column) -> Column:
    """Text of a value: a string itself, anything else as JSON; NULL if null or absent."""
    return F.try_variant_get(value, "$", "string")


def is_string(value: Column, plain: Column | None = None) -> Column:
    """Whether a value is a JSON string; never NULL.

    ``plain`` is its ``plain_text`` where a column holds that already. The type
    is looked up only for texts that leave a doubt.
    """
    plain = plain_text(value) if plain is None else plain
    return (
        F.when(plain.isNull(), F.lit(False))
        .when(plain.rlike(_NOT_ONLY_STRING), F.schema_of_variant(value) == "STRING")
        .otherwise(F.lit(True))
    )


def is_falsy(value: Column, plain: Column | None = None) -> Column:
    """Absent, null, false, zero, empty string, empty array or empty object."""
    plain = plain_text(value) if plain is None else plain
    return (
        F.when(plain.isNull() | (plain == ""), F.lit(True))
        .when(plain.rlike(_FALSY_TEXT), F.schema_of_variant(value) != "STRING")
        .otherwise(F.lit(False))
    )


def text_of(value: Column, plain: Column | None = None) -> Column:
    """The value as Python's ``str`` prints it; NULL where the key is absent.

    Strings are themselves, null is ``None``, booleans are ``True``/``False``,
    a float without fraction keeps its ``.0``. Arrays and objects print as
    JSON, and exponents follow Java.
    """
    plain = plain_text(value) if plain is None else plain
    kind = F.schema_of_variant(value)
    looked_up = (
        F.when(kind == "BOOLEAN", F.initcap(plain))
        .when(kind.rlike(r"^DECIMAL\(([1-9]|1[0-8]),0\)$"), F.concat(plain, F.lit(".0")))
        .otherwise(plain)
    )
    # the value itself is looked up only where its text leaves a doubt
    absent = F.when(value.isNotNull(), F.lit("None"))
    return F.when(plain.isNull(), absent).when(plain.rlike(_NOT_ONLY_STRING), looked_up).otherwise(plain)
