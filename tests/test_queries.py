"""Every query with oracle SQL, against DuckDB on the smallest tables; a few operators on odd input."""

import duckdb
import pytest

import __spark_entry__ as entry
from docloom.operators import candidates
from docloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, tiny, name):
    got = registry.QUERIES[name](spark, tiny)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(map(repr, want.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == rows and rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_sampling_is_even(spark):
    df = spark.range(10)
    assert sorted(r.id for r in candidates.sample_even(df, "id", 4, width=3).collect()) == [0, 2, 5, 7]
    assert candidates.sample_even(df, "id", 0).count() == 0 and candidates.sample_even(df, "id", 99).count() == 10
