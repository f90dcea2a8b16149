"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidegrid.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    got = registry.QUERIES[name](spark, SF)
    rows = canonical(got.collect(), got.columns)
    assert rows
    if name in registry.ORACLE_SQL:
        want = oracle.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(got.columns)
        assert rows == canonical(want.fetchall(), want.columns)
