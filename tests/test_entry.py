"""Every registered query against its SQL at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "conversations", "labels", "pages", "embeddings"]
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    rows = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in rows.description]
    assert sorted(df.columns) == sorted(columns)
    tidy = lambda x: round(x, 9) if isinstance(x, float) else x
    expected = sorted((tuple(tidy(v) for v in r) for r in rows.fetchall()), key=repr)
    assert sorted((tuple(tidy(r[c]) for c in columns) for r in df.collect()), key=repr) == expected


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
