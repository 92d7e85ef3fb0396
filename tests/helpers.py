"""Runs queries in Spark and their SQL in DuckDB and compares whole results."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sf_dir(name: str = "sf0.001") -> str:
    return f"/root/testdata/{name}"


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    return repr(float(value)) if isinstance(value, (int, float)) else str(value)


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def sql_rows(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(plain(r[k]) for k in order) for r in done.fetchall())
