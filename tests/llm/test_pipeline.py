"""The pipeline stage by stage on a small table, and the SQL of the query that has one."""

import re

import corpus_pipeline
import duckdb
import pytest
from tessera.llm import mixing, nearcopies, packing, secrets, simhash
from tessera.llm.queries import oracle_sql, queries

from tests.conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        out[name] = docs, spark.read.parquet(f"{root}/{name}")
        docs = out[name][1]
    return out


def test_columns_and_clean_documents_stay(stages):
    for name in ("language_id", "simhash_near_dedup", "secret_scan", "mix_sources"):
        before, after = stages[name]
        assert after.columns == before.columns and after.count() > 0
    assert stages["language_id"][1].count() == stages["language_id"][0].count()


def test_one_document_of_each_group(spark, stages):
    before, after = stages["simhash_near_dedup"]
    kept = {r.component_id for r in nearcopies.near_copies(spark, before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(kept)
    # Groups of op10 (2 bits of 64 over three words) are finer here: each has at most one document left.
    groups = {r.doc_id: r.component_id for r in simhash.simhash_components(spark, before).collect()}
    left = [groups[r.doc_id] for r in after.collect()]
    assert len(left) == len(set(left))


def test_no_secret_is_left(stages):
    before, after = stages["secret_scan"]
    assert after.count() == before.count()
    for r in after.collect():
        assert not re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", r.text) and r.n_chars == len(r.text)


def test_mix_takes_what_the_plan_says(spark, stages):
    before, after = stages["mix_sources"]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert sum(words(r.text) for r in after.collect()) == sum(r.taken for r in mixing.mix(spark, before).collect())


def test_every_token_is_packed(stages):
    before, after = stages["pack"]
    tokens = packing.WordTokens(packing.vocabulary())
    total = sum(len(x) // tokens.kind.itemsize + 1 for x in tokens.encode([r.text for r in before.collect()], b""))
    assert sum(r.length for r in after.collect()) == total


def test_run_equals_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(r) for r in df.select(*columns).collect())
    assert ours == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall())


def test_a_secret_is_found_in_the_table(spark):
    assert secrets.op3_secret_scan(spark, f"{DATA}/sf0.01").where("n_assign > 0").count() > 0
