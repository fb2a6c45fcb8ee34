import os

import duckdb
import pytest

import __spark_entry__
from lectern.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else list(map(norm, v)) if isinstance(v, list) else v
    want = c.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({registry.oracle_sql()[name]})").fetchall()
    got = [tuple(norm(r[n]) for n in names) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(map(norm, r))) for r in want)
