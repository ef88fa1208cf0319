"""Every unit TF-IDF weight against a plain-Python model on a small table."""

import math
from collections import Counter

from tessera.functions.text import tokens
from tessera.plans.catalog import QUERIES

from tests.conftest import DATA


def test_all_unit_weights(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").orderBy("doc_id").limit(12)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bags = {r.doc_id: Counter(r.w) for r in docs.select("doc_id", tokens("text").alias("w")).collect()}
    df = Counter(t for b in bags.values() for t in b)
    model = {}
    for i, b in bags.items():
        raw = {t: (1 + math.log(k)) * (math.log((len(bags) + 1) / (df[t] + 1)) + 1) for t, k in b.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        model |= {(i, t): x / norm for t, x in raw.items()}
    got = {(r.doc_id, r.term): r.w for r in QUERIES["tfidf_all_unit_weights"](spark, str(tmp_path)).collect()}
    assert got.keys() == model.keys() and all(abs(got[k] - model[k]) < 2e-6 for k in got)
    assert min(got.values()) < 0.2
