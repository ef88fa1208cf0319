"""Passages of a batch in slices; unit weights without a second join of all postings."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F
from tessera.functions.text import packed_passages, passage_arrays
from tessera.operators import index as I


def test_passages_of_a_batch_are_made_in_slices():
    texts = pa.array([None, "", *["One short sentence stands here. Another one follows it.  " * 5000] * 40])
    tracemalloc.start()
    got = passage_arrays(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].as_py() is None and got[1].as_py() == []
    assert [tuple(p.values()) for p in got[41].as_py()] == packed_passages(texts[41].as_py())
    assert peak < 12_000_000  # of 11 million characters, most of them in passages twice


def test_unit_weights_join_postings_once(spark):
    post = spark.createDataFrame([("a", 1, "x", 2), ("a", 1, "y", 1), ("a", 2, "x", 1), (None, None, "x", 1)], "domain string, doc_id long, term string, tf long")
    stats = I.term_stats(post, []).withColumn("n", F.lit(3))
    w = I.tfidf(post, stats, F.col("n"), ["domain", "doc_id"], [])
    assert w._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    sums = {r.doc_id: r.s for r in w.groupBy("doc_id").agg(F.round(F.sum(F.col("w") * F.col("w")), 9).alias("s")).collect()}
    assert sums == {1: 1.0, 2: 1.0, None: 1.0}
