"""Every registered query of the engine with SQL gives the same rows as DuckDB over the same tables."""

import decimal
from collections import Counter

import duckdb
import pytest

from siltlog import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, sf, duck, name):
    frame = catalogue.queries()[name](spark, sf)
    names = sorted(frame.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in frame.collect())
    found = duck.execute(catalogue.oracle_sql()[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    want = Counter(tuple(plain(r[order.index(c)]) for c in names) for r in found.fetchall())
    assert got == want
    assert want or name in {"sort_check", "duplicate_keys", "point_lookup", "scan_base_window"}
