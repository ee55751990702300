"""Every query of the library against its SQL."""

import math
from collections import Counter

import duckdb
import pytest
from strandline.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    return con


def plain(row):
    return tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    rows = Counter(plain(r) for r in found.select(*want.columns).collect())
    other = Counter(map(plain, want.fetchall()))
    assert rows and rows == other, (list((rows - other))[:2], list((other - rows))[:2])
