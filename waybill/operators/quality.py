"""Constraints every source and every plan must meet, and scans for leaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions import secrets
from waybill.functions.text import replacements


def string_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def verdict(violations: DataFrame, check: str) -> DataFrame:
    """One row: how many violations there are and whether the check holds."""
    return violations.agg(F.count("*").alias("violations")).select(
        F.lit(check).alias("check"), "violations", (F.col("violations") == 0).alias("ok")
    )


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with how many hold them."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def orphans(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose (non-null) reference does not exist."""
    known = parents.select(F.col(key).alias(column))
    return df.where(F.col(column).isNotNull()).join(known, column, "left_anti")


def undeclared_cells(cells: DataFrame, fields: DataFrame) -> DataFrame:
    return cells.join(fields.select("collection", "field_id"), ["collection", "field_id"], "left_anti")


def unexplained_losses(actions: DataFrame, findings: DataFrame) -> DataFrame:
    """Lossy or unsupported actions that no finding explains. findings: action_id."""
    explained = findings.select(F.col("action_id").alias("id"))
    return actions.where(F.col("outcome").isin("lossy", "unsupported")).join(explained, "id", "left_anti")


def long_strings(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per (row, string column), without a shuffle."""
    pairs = [F.struct(F.lit(c).alias("path"), F.col(c).alias("text")) for c in columns]
    return df.select(*keys, F.inline(F.array(*pairs)))


def contains_values(df: DataFrame, keys: list[str], needles: list[str]) -> DataFrame:
    """String cells that hold one of a handful of given values (credentials in use)."""
    columns = [c for c in string_columns(df) if c not in keys]
    hit = reduce(lambda a, n: a | F.contains(F.col("text"), F.lit(n)), needles, F.lit(False))
    return long_strings(df, keys, columns).where(hit).select(*keys, "path")


def leak_scan(df: DataFrame, keys: list[str], names: dict[str, str] | None = None,
              paths: dict[str, str] | None = None, rules: dict[str, str] | None = None) -> DataFrame:
    """Secrets, machine paths and given names in any string column, with where they are.

    ``names`` maps a whole word to what it is, ``paths`` a substring to what it is. ``rules`` are the patterns looked
    for (by default those of credentials; ``secrets.MACHINE_PATHS`` are those of places on a machine). Every test runs
    inside the row; one pass over the table, no shuffle. For many names see ``needles.needle_scan``.
    """
    columns = [c for c in string_columns(df) if c not in keys]
    text = F.col("text")
    tests: list[tuple[str, Column]] = [(what, secrets.holds(text, p)) for what, p in (secrets.LEAK_RULES if rules is None else rules).items()]
    for word, what in (names or {}).items():
        quoted = "".join("\\" + c if not c.isalnum() else c for c in word)
        tests.append((what, text.rlike(rf"(?<![A-Za-z0-9]){quoted}(?![A-Za-z0-9])")))
    for part, what in (paths or {}).items():
        tests.append((what, F.contains(text, F.lit(part))))
    kinds = F.array_compact(F.array(*[F.when(test, F.lit(what)) for what, test in tests]))
    return long_strings(df, keys, columns).select(*keys, "path", F.explode(kinds).alias("leak"))


def url_hosts(df: DataFrame, columns: list[str], allowed: DataFrame) -> DataFrame:
    """Distinct hosts mentioned anywhere in the columns, minus an allow-list (column host)."""
    address = F.lit(r"""(?i)\b([a-z][a-z0-9+.-]*://[^\s"'<>)\]]+)""")
    every = F.concat(*[F.coalesce(F.regexp_extract_all(F.col(c), address, F.lit(1)), F.array()) for c in columns])
    found = df.select(F.explode(every).alias("url"))
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    hosts = found.select(F.lower(host).alias("host")).where(F.col("host").isNotNull()).distinct()
    return hosts.join(allowed, "host", "left_anti")


def replace_everywhere(df: DataFrame, needle: str, replacement: str) -> DataFrame:
    """Replace a text in every string column and count the replacements per row."""
    total: Column = F.lit(0).cast("bigint")
    changed: dict[str, Column] = {}
    for name in string_columns(df):
        text, count = replacements(F.col(name), needle, replacement)
        changed[name] = text
        total = total + F.coalesce(count, F.lit(0).cast("bigint"))
    return df.withColumns({**changed, "replaced": total})
