"""The queries of this folder that SQL can express agree with DuckDB on the same tables."""

import duckdb
import pytest
from tessera.llm.queries import oracle_sql, queries

from tests.conftest import DATA


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_hard_negatives"])
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.01/{t}.parquet'")
    df = queries()[name](spark, f"{DATA}/sf0.01")
    columns = sorted(df.columns)
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert columns == sorted(con.sql(oracle_sql()[name]).columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(theirs, key=repr) != []
