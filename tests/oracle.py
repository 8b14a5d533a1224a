"""Run a query on Spark and its SQL on DuckDB, and compare rows without order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return ("nan",) if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(map(_cell, x))
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_cell(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, query, sql, sf_dir) -> list[str]:
    """What differs; empty if nothing does."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} and {sorted(rel.columns)}"]
    a, b = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    if len(a) != len(b):
        return [f"rows {len(a)} and {len(b)}"]
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return [f"{len(bad)} rows differ, first {str(bad[0])[:600]}"] if bad else []
