"""Values without a schema as columns: JSON texts, read as variants and taken apart by type.

A value is written as JSON. null, booleans, numbers, strings, arrays and objects are JSON's
own; what JSON can't say is an object with one key: {"$date": ISO text, UTC}, {"$number":
"NaN" | "Infinity" | "-Infinity"}, {"$error": {"name", "message"}}.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ODD = ("NaN", "Infinity", "-Infinity")


def encoded(value: Column, kind: str) -> Column:
    """The text of a column of this kind: null, boolean, number, string, date (a timestamp), or value (arrays, maps and structs, as JSON has them). A null of any kind is `null`."""
    if kind == "number":
        odd = F.when(F.isnan(value.cast("double")), "NaN").when(value.cast("double") == float("inf"), "Infinity").when(value.cast("double") == float("-inf"), "-Infinity")
        text = F.when(odd.isNotNull(), F.to_json(F.struct(odd.alias("$number")))).otherwise(value.cast("string"))
    elif kind == "boolean":
        text = value.cast("string")
    elif kind == "date":
        text = F.to_json(F.struct(F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("$date")))
    elif kind == "string":
        text = F.substring(F.to_json(F.struct(value.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(value.alias("v")))) - 6)
    elif kind == "value":
        text = F.to_json(value)
    elif kind == "null":
        return F.lit("null")
    else:
        raise ValueError(f"unknown kind {kind}")
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def decoded(text: Column) -> Column:
    """The variant of a text; null for a text that is no JSON."""
    return F.try_parse_json(text)


def kind_of(value: Column) -> Column:
    """null, boolean, number, string, array, object, date or error, of a decoded value."""
    schema = F.schema_of_variant(value)
    tagged = lambda tag: F.try_variant_get(value, f"$['{tag}']", "variant").isNotNull()
    return (
        F.when(F.is_variant_null(value), "null")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "STRING", "string")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), F.when(tagged("$date"), "date").when(tagged("$error"), "error").when(tagged("$number"), "number").otherwise("object"))
        .when(schema.isNotNull(), "number")
    )


def as_number(value: Column) -> Column:
    odd = F.try_variant_get(value, "$['$number']", "string")
    return F.coalesce(F.try_variant_get(value, "$", "double"), F.when(odd.isin(*_ODD), odd.cast("double")))


def as_string(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def as_date(value: Column) -> Column:
    """A timestamp."""
    return F.try_to_timestamp(F.try_variant_get(value, "$['$date']", "string"))


def member(value: Column, path: str, kind: str) -> Column:
    """What stands at a path such as `$.a[0]`, as a Spark type; null if it is absent or of another type."""
    return F.try_variant_get(value, path, kind)
