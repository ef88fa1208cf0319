"""Tiles of cosines: equal to scoring.cosine on odd rows, best of a question by rounded score and id, few rows left."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.functions import scoring as S
from tessera.operators.tiles import Tiles, best, rounded
from tessera.plans import queries_search as Q

ODD = [(900, None), (901, [0.0] * 8), (902, [1.0] * 7 + [None]), (903, [1e-200] * 8), (904, [float("nan")] * 8)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 8)).astype(np.float32)
    x[400:600] = x[7]
    rows = list(enumerate(x.astype(float).tolist())) + ODD
    return spark.createDataFrame(rows, "vec_id long, vector array<double>").cache()


def test_equal_to_the_cosine_of_pairs(spark, table):
    asked = table.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "vector")
    t = Tiles(table, asked, block=100, strip=3)
    mine = {(r.q_id, r.vec_id): r.c for r in t.all().collect()}
    pairs = table.join(asked.toDF("q_id", "qv"), F.col("q_id") != F.col("vec_id"))
    plain = {(r.q_id, r.vec_id): r.c for r in pairs.select("q_id", "vec_id", S.cosine(F.col("qv"), F.col("vector")).alias("c")).collect()}
    assert mine == plain and len(plain) == 9 * 804
    bounds = {r.q_id: (r.low, r.high) for r in t.bounds().collect()}
    assert bounds == {q: (min(c for (p, _), c in plain.items() if p == q), max(c for (p, _), c in plain.items() if p == q)) for q in bounds}
    found = t.best(10, 6).collect()
    assert len(found) <= 9 * 10 * 9  # of each question at most ten a block
    for q in bounds:
        first = lambda rows: [v for _, v in sorted(rows)[:10]]
        assert first((-rounded(np.array([r.c]), 6)[0], r.vec_id) for r in found if r.q_id == q) == first((-rounded(np.array([c]), 6)[0], v) for (p, v), c in plain.items() if p == q)


def test_rounds_as_spark_does(spark):
    x = [0.1234565, -0.1234565, 0.1234575, 0.9999995, 1.0, -1.0, 0.0, 2.5e-7, 5e-7, 0.8765435]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert rounded(np.array(x), 6).tolist() == [r[0] for r in df.select(F.round("x", 6)).collect()]


def test_ties_go_to_the_lesser_id():
    score, ids = np.array([0.5, 0.5000000001, 0.7, 0.5, 0.1]), np.array([9, 8, 7, 1, 0])
    assert ids[best(score, ids, 3, 6)].tolist() == [7, 1, 8]


@pytest.mark.parametrize("name", ["dense_cosine_topk", "minmax_norm", "rrf_fusion", "calibrated_relevance", "evidence_floor", "mmr_select"])
def test_no_loop_over_pairs_of_rows(spark, name):
    """Blocks meet, not rows: the lambdas that scored single pairs are gone from the plan."""
    plan = getattr(Q, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan
