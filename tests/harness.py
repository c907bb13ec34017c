"""Run a registered query and its SQL, and compare names, types and rows."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _cell(value: object) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def _rows(rows: list, order: list[int]) -> list[tuple]:
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, key: str, query, sf_dir: str) -> str:
    """Empty when both agree, else what differs."""
    from runlens.plans.registry import Tables

    start = time.time()
    df = query.build(Tables(spark, sf_dir))
    names = df.columns
    types = dict(df.dtypes)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if query.sql is None:
        return "" if names else "no columns"
    result = con.execute(query.sql)
    columns = [(d[0], str(d[1])) for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(c for c, _ in columns):
        return f"columns {names} against {[c for c, _ in columns]}"
    wrong = [(c, types[c], t) for c, t in columns if TYPES.get(types[c], types[c]) != t]
    if wrong:
        return f"types {wrong}"
    left = _rows(rows, [names.index(c) for c in sorted(names)])
    right = _rows(expected, [[c for c, _ in columns].index(c) for c in sorted(names)])
    if left == right:
        return ""
    gone, extra = set(right) - set(left), set(left) - set(right)
    return f"rows {len(left)}/{len(right)}; only sql {sorted(gone)[:2]}; only spark {sorted(extra)[:2]} ({spent:.1f}s)"
