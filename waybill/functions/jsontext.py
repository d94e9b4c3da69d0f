"""Canonical JSON text and lenient reading of loosely typed JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waybill.functions.text import number_text


def quote(text: Column) -> Column:
    """A string as a JSON literal."""
    boxed = F.to_json(F.array(text))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def finite(number: Column) -> Column:
    """The number; a non-finite one is an error because it has no stable text."""
    bad = F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("non-finite number in canonical JSON"))).otherwise(
        number
    )


def canonical_json(members: dict[str, tuple[Column, str]]) -> Column:
    """Sorted-key JSON without white space. ``members`` maps a name to (column, kind).

    kind: string, number (double), plain (integers, booleans) or json (already JSON text).
    Null members are left out, as absent values are.
    """
    encoders = {
        "string": quote,
        "number": lambda c: number_text(finite(c)),
        "plain": lambda c: c.cast("string"),
        "json": lambda c: c,
    }
    parts = [
        F.when(
            members[name][0].isNotNull(),
            F.concat(F.lit(f'"{name}":'), encoders[members[name][1]](members[name][0])),
        )
        for name in sorted(members)
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def canonical_map(entries: Column) -> Column:
    """A string-to-string map as sorted-key JSON."""
    ordered = F.array_sort(F.map_entries(entries))
    parts = F.transform(ordered, lambda e: F.concat(quote(e["key"]), F.lit(":"), quote(e["value"])))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def kind_of_schema(shape: Column) -> Column:
    """JSON kind from the schema text of a variant: null, string, number, boolean, array, object."""
    return F.coalesce(
        F.when(shape.startswith("OBJECT"), F.lit("object"))
        .when(shape.startswith("ARRAY"), F.lit("array"))
        .when(shape == "STRING", F.lit("string"))
        .when(shape == "BOOLEAN", F.lit("boolean"))
        .when(shape == "VOID", F.lit("null"))
        .when(shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit("number")),
        F.lit("missing"),
    )
