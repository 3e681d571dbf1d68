"""Every query of the library against its oracle on the smallest tables."""

import os

import duckdb
import pytest

from lattica.plans import catalog

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, records):
    value = lambda x: repr(round(x, 9) if isinstance(x, float) else x)
    return sorted(tuple(value(r[names.index(k)]) for k in sorted(names)) for r in records)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in catalog.ORACLES:
        want = con.sql(catalog.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())
