"""Expressions with the meaning that web scripts give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts trim it.
_EDGES = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def or_default(text: Column, default: str) -> Column:
    """The default in place of null and of the empty text."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def number_or_zero(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).try_cast("bigint"), F.lit(0))


def truthy(value: Column) -> Column:
    """Whether a variant value counts as true: not missing, null, false, 0, NaN or an empty text; empty arrays and objects do."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    return F.coalesce(
        F.when(value.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), (number != 0) & ~F.isnan(number))
        .otherwise(F.lit(True)),
        F.lit(False),
    )


#: What JSON texts may not have, though Spark's reader would take it.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def read_object(text: Column, fields: str) -> Column:
    """An array with the JSON object in ``text`` as a struct of ``fields``, or with null for a JSON null; null where the text is no JSON or no object.

    The text is read in brackets with a null behind it, so that anything else behind its value shows. A byte order mark in front is left out; the last of repeated keys counts."""
    inside = F.concat(F.lit("["), F.regexp_replace(F.coalesce(text, F.lit("")), "^\\x{FEFF}", ""), F.lit(",null]"))
    read = F.from_json(inside, f"array<struct<{fields}>>", STRICT)
    return F.when((F.size(read) == 2) & F.get(read, F.lit(1)).isNull(), F.slice(read, 1, 1))


def shown(value: Column) -> Column:
    """A variant value as the text that scripts make of it: the parts of a flat array joined by commas, a fixed text for an object."""
    kind = F.schema_of_variant(value)
    joined = F.array_join(F.try_variant_get(value, "$", "array<string>"), ",", "")
    return F.when(kind.startswith("OBJECT"), "[object Object]").when(kind.startswith("ARRAY"), joined).otherwise(F.try_variant_get(value, "$", "string"))
