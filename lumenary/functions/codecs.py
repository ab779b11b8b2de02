"""Tolerant decoding of JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenary.functions.text import empty_strings
from lumenary.functions.vector import no_vector


def _is_array(text: Column) -> Column:
    return F.coalesce(F.trim(text).startswith("["), F.lit(False))


def decode_list(text: Column) -> Column:
    """JSON array to strings; anything else is empty. Null and booleans are spelled None/True/False."""

    def spell(item: Column) -> Column:
        kind = F.schema_of_variant(item)
        plain = item.cast("string")
        return (
            F.when(item.isNull() | (kind == "VOID"), F.lit("None"))
            .when(kind == "BOOLEAN", F.initcap(plain))
            .otherwise(plain)
        )

    items = F.try_parse_json(text).try_cast("array<variant>")
    return F.coalesce(F.transform(items, spell), empty_strings())


def decode_records(text: Column, record: str) -> Column:
    """JSON array of objects; other items are dropped one by one instead of voiding the array."""
    items = F.from_json(text, "array<string>")
    objects = F.filter(items, lambda x: F.coalesce(x.startswith("{"), F.lit(False)))
    rows = F.transform(objects, lambda x: F.from_json(x, record))
    return F.coalesce(F.when(_is_array(text), rows), F.array().cast(f"array<{record}>"))


def encode_vector(v: Column) -> Column:
    return F.to_json(F.transform(v.cast("array<double>"), lambda x: F.round(x, 6)))


def decode_vector(text: Column) -> Column:
    values = F.from_json(text, "array<double>")
    whole = _is_array(text) & F.forall(F.coalesce(values, no_vector()), lambda x: x.isNotNull())
    return F.coalesce(F.when(whole, values), no_vector())
