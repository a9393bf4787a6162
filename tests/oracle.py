"""Compares a query's rows with those of its SQL on DuckDB, regardless of order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(spark, query, sql: str, sf_dir: str) -> list[str]:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    df = query(spark, sf_dir)
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    out = [] if len(got) == len(want) else [f"{len(got)} and {len(want)} rows"]
    return out + [f"{a} | {b}" for a, b in zip(got, want) if a != b][:3]
