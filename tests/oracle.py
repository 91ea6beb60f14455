"""Compares a query with its oracle SQL in DuckDB over the same tables."""

import datetime
import decimal
import math
import os

import duckdb


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns, tuples, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(norm(t[i]) for i in at) for t in tuples), key=repr)


def matches(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    found = con.sql(sql)
    assert sorted(found.columns) == sorted(df.columns)
    order = sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()], order) == rows(list(found.columns), found.fetchall(), order)
