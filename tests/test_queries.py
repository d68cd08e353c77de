"""Every registered query of the reference's operators against its SQL, on whole tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from fenmark.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(x):
    if isinstance(x, (float, Decimal)):
        x = float(x)
        return "null" if math.isnan(x) else f"{x + 0.0:.4f}"
    return "null" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert set(columns) == set(got.columns)
    kinds = dict(got.dtypes)
    as_is = lambda r: tuple(norm(float(v) if kinds[c] == "double" and v is not None else v) for c, v in zip(columns, r, strict=True))
    assert sorted(map(as_is, got.select(*columns).collect())) == sorted(map(as_is, want.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_is_stable(spark, name):
    a, b = (sorted(map(repr, QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a == b and a


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
