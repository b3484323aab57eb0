import os

import duckdb
import pytest

import __spark_entry__ as entry
from sievelark.plans.catalog import registry
from tools.check_queries import TABLES, close, plain

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="test tables are missing")

# every query of the package itself that has SQL; the corpus queries have tests of their own
NAMES = sorted(registry.SQL)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{BASE}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, BASE)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want) and all(close(a, b) for a, b in zip(got, want))


def test_entry_points():
    assert set(entry.oracle_sql()) <= set(entry.queries())
