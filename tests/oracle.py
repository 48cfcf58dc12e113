"""Runs a registered query and its DuckDB SQL over the same tables and compares them."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{path if path.is_file() else str(path) + '/*.parquet'}'")
    return con


def _plain(value):
    if isinstance(value, dict):
        return tuple((k, _plain(v)) for k, v in sorted(value.items(), key=str))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return int(value) if type(value).__name__ in ("int", "Decimal") and value == int(value) else str(value)


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """'' if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r.asDict(True)[c] for c in df.columns) for r in df.collect()])
    con = connect(sf_dir)
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rows_of(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(columns)}"
    if got != want:
        odd = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"{name}: {len(got)} and {len(want)} rows, first {odd}"
    return ""
