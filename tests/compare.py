"""Run queries beside their SQL and compare columns, types, row counts and values.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from waybill.session import local_session  # noqa: E402
from workload import load_all  # noqa: E402
from workload.tables import NAMES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "tolist"):
        return _plain(value.tolist())
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if value is pd.NaT:
        return None
    return value


def rows_of(table, names: list[str]) -> list[tuple]:
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns), key=repr)


def type_name(kind) -> str:
    return str(kind).replace("large_", "")


def compare(query, spark, sf_dir: str, con) -> tuple[str, int]:
    got = query(spark, sf_dir).toArrow()
    if query.sql is None:
        return "rows-only", got.num_rows
    want = con.sql(query.sql).to_arrow_table()
    names = sorted(got.column_names)
    if names != sorted(want.column_names):
        return f"columns {names} != {sorted(want.column_names)}", got.num_rows
    types = [
        (n, type_name(got.schema.field(n).type), type_name(want.schema.field(n).type))
        for n in names
    ]
    bad = [t for t in types if t[1] != t[2]]
    a, b = rows_of(got, names), rows_of(want, names)
    if a != b:
        left, right = set(a) - set(b), set(b) - set(a)
        return (
            f"values differ: {len(a)} vs {len(b)} rows; {names}\n  spark only "
            f"{sorted(left, key=repr)[:3]}\n  sql only {sorted(right, key=repr)[:3]}"
        ), got.num_rows
    if bad:
        return f"types {bad}", got.num_rows
    return "ok", got.num_rows


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.001"
    wanted = args[1:]
    registry = load_all()
    spark = local_session()
    con = connect(sf_dir)
    failed = 0
    for name, query in registry.items():
        if wanted and not any(name == w or query.run.__module__.endswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            verdict, rows = compare(query, spark, sf_dir, con)
        except Exception as error:  # noqa: BLE001 - the report names every failing query
            text = str(error) or traceback.format_exc()
            verdict, rows = f"error {type(error).__name__}: {text[:900]}", -1
        if verdict not in ("ok", "rows-only"):
            failed += 1
        print(f"{name:28s} {verdict} rows={rows} {time.time() - start:.2f}s", flush=True)
    print(f"failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
