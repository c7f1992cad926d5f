"""Comparing a Spark query with its SQL on the given tables."""

import datetime as dt

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.sql(sql)
    return list(got.columns), got.fetchall()


def assert_same(df, sf_dir: str, sql: str) -> None:
    columns, expected = oracle_rows(sf_dir, sql)
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    ours = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    theirs = sorted(tuple(shown(r[columns.index(c)]) for c in names) for r in expected)
    assert ours == theirs
