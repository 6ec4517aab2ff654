"""Spark result against DuckDB result: names, types, and rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(f"{sf_dir}/{name}.parquet")
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


SPARK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def differences(df, con, sql: str) -> str | None:
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    types = dict(zip(names, [str(c[1]) for c in result.description]))
    theirs = result.fetchall()
    columns = sorted(df.columns)
    if columns != sorted(names):
        return f"columns {columns} against {sorted(names)}"
    ours_types = {n: SPARK_TYPES.get(t, t) for n, t in df.dtypes}
    if ours_types != types:
        return f"types {ours_types} against {types}"
    ours = sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in order) for r in theirs), key=_key)
    if len(ours) != len(theirs):
        extra = [r for r in ours if r not in set(theirs)][:2]
        lacking = [r for r in theirs if r not in set(ours)][:2]
        return f"{len(ours)} rows against {len(theirs)}; only ours {extra}; only theirs {lacking}"
    for a, b in zip(ours, theirs):
        if not all(map(_same, a, b)):
            return f"{columns}: {a} against {b}"
    return None
