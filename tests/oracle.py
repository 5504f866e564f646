"""Runs registered queries next to their SQL and compares the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import pathlib

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if pathlib.Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, bool):
        return ("bool", str(v))
    if isinstance(v, int):
        return ("int", str(v))
    if isinstance(v, float):
        return ("float", repr(v))
    if isinstance(v, dt.datetime):
        return ("time", v.isoformat())
    return (type(v).__name__, str(v))


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    got_cols, got = normal_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = normal_rows([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}: {[x for x in got if x not in set(want)][:2]} / {[x for x in want if x not in set(got)][:2]}"
    for a, b in zip(got, want):
        if a != b:
            diff = [(c, x, y) for c, x, y in zip(got_cols, a, b) if x != y]
            return f"row differs at {diff[:4]}; {len(set(got) ^ set(want))} rows differ in all"
    return None
