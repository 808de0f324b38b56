"""Runs a query and its SQL twin on the same tables and compares the rows."""

import decimal
import os

import duckdb

from factloom.sources.tables import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(spark, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    theirs_names = [x[0] for x in got.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(c) for c in names]
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())
    assert mine == theirs
