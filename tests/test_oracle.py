"""Every query with SQL, against DuckDB on the same tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from foliolake import catalog
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    same = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v
    return sorted((tuple(same(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert _rows(df.columns, got) == _rows(want.columns, want.fetchall())
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
