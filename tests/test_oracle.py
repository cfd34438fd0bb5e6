"""Every query outside the training-data subpackage that has SQL gives the same rows as that SQL, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from folio.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else int(v) if v == int(v) else round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, duck, sf):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert mine == sorted((tuple(norm(r[k]) for k in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0
