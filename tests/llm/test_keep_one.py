"""Rows that share ids or texts in the near-dedup stage, and columns of any name."""

import pytest
from tessera.llm import mixing, nearcopies, secrets, simhash

A = " ".join(f"alpha{k}" for k in range(40))
B = " ".join(f"beta{k}" for k in range(40))
C = " ".join(f"gamma{k}" for k in range(40))
ROWS = [(5, A), (5, B), (5, C), (1, A), (None, B), (None, "only here and without an id"), (7, C), (7, C), (9, None), (8, "")]


@pytest.mark.parametrize("grouped", [simhash.simhash_components, nearcopies.near_copies])
@pytest.mark.parametrize("parts", [1, 7])
def test_decided_by_row(spark, grouped, parts):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(parts)
    out = sorted(((r.doc_id, r.text) for r in simhash.keep_one(spark, docs, grouped).collect()), key=str)
    assert out == sorted([(1, A), (5, B), (5, C), (None, "only here and without an id"), (8, "")], key=str)


@pytest.mark.parametrize("run", [simhash.keep_one, secrets.redacted, mixing.mixed_documents])
def test_columns_with_dots_and_quotes(spark, run):
    docs = spark.createDataFrame([(k, f"text {k} of its own", "s", "kept", "too") for k in range(6)], "doc_id long, text string, source string, `a.b` string, `c``d` string")
    out = run(spark, docs)
    assert out.columns == docs.columns
    assert all(r[3] == "kept" and r[4] == "too" for r in out.collect())
