"""Compares a registered query with its statement, as the driver does but with a readable diff."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

_SPARK = {"bigint": "int64", "double": "float64", "string": "object", "boolean": "bool"}
_DUCK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{file}')")
    return con


def canonical(rows: list[tuple], names: list[str]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "\0" if v is None else (repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v))
    return [names[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if equal, else what differs."""
    relation = con.sql(sql)
    expected_types = dict(zip(relation.columns, (_DUCK.get(str(t), str(t)) for t in relation.types)))
    actual_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if actual_types != expected_types:
        wrong = {k: (actual_types.get(k), expected_types.get(k)) for k in {**actual_types, **expected_types}
                 if actual_types.get(k) != expected_types.get(k)}
        return f"schema (spark, duckdb): {wrong}"
    names, actual = canonical([tuple(r) for r in df.collect()], df.columns)
    _, expected = canonical(relation.fetchall(), list(relation.columns))
    if actual == expected:
        return None
    a, e = pd.Series(actual).value_counts(), pd.Series(expected).value_counts()
    extra = [x for x in a.index if a[x] > e.get(x, 0)][:4]
    lacking = [x for x in e.index if e[x] > a.get(x, 0)][:4]
    return f"rows {len(actual)} / {len(expected)}; columns {names}\n  only spark:  {extra}\n  only duckdb: {lacking}"
