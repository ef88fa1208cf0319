"""Every query with SQL agrees with DuckDB on the same tables."""

import math

import duckdb
import pytest
from tessera.plans.catalog import ORACLES, QUERIES

from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"engine_answers", "lsa_similarity"}  # in test_engine.py and test_latent.py


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return repr(int(v)) if isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    columns = sorted(df.columns)
    assert columns == sorted(duck.sql(ORACLES[name]).columns)
    ours = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    theirs = sorted(tuple(map(shown, r)) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())
    assert ours == theirs and ours


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry_imports_and_lists_queries(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
