"""Spark's rows against DuckDB's for queries that have SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(query, spark, sf_dir):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    return columns, sorted((tuple(_plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.sql(sql)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return [got.columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
