"""Hard negatives against a plain loop over all pairs: ties, copies, large components, odd rows."""

import math

import numpy as np
import pytest
from tessera.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def model(rows):
    held = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        bound = N.largest(len(v))
        held.append((i, label, [max(-bound, min(bound, math.floor(256 * float(np.float32(x))))) for x in v]))
    out = []
    place = lambda i: (i is None, i or 0)
    for k, (i, label, v) in enumerate(held):
        if i is None or i % 100:
            continue
        others = [(sum(a * b for a, b in zip(v, w)), j, lab) for n, (j, lab, w) in enumerate(held) if n != k and len(w) == len(v)]
        others.sort(key=lambda o: (-o[0], place(o[1])))
        for p in [o for o in others if o[2] == label][:5]:
            window = [o for o in others if o[2] != label and 30 * p[0] <= 100 * o[0] <= 90 * p[0]][:10]
            out += [(i, p[1], r, o[1], p[0], o[0]) for r, o in enumerate(window, 1)]
    return sorted(map(repr, out))


def mined(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS uid", "1 AS size", "2 AS codes").write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(repr(tuple(r)) for r in N.op12_hard_negatives(spark, str(tmp_path)).collect())


@pytest.mark.parametrize("seed,spread", [(1, 0.3), (2, 0.02), (3, 3e4)])
def test_equals_all_pairs(spark, tmp_path, seed, spread):
    rng = np.random.default_rng(seed)
    rows = [(k, (spread * rng.normal(size=8 if k % 9 else 7)).tolist(), int(rng.integers(0, 3))) for k in range(700)]
    rows += [(k, rows[k % 5][1], k % 3) for k in range(700, 900)]  # copies of a few: ties
    assert mined(spark, rows, tmp_path) == model(rows) != []


def test_odd_rows(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.5], 1), (None, [0.8, 0.0], 1), (None, [0.5, 0.1], 2), (100, None, 1), (200, [1.0, None], 1), (300, [math.nan, 1.0], 1), (400, [1.0, 2.0], None), (1, [math.inf, 1.0], 2),
            (2, [0.5, 0.0], 2), (2, [0.5, 0.0], 2), (3, [0.4, 0.0], 2), (500, [], 1), (501, [], 1), (502, [], 2), (600, [3e38, 3e38], 1), (601, [3e38, -3e38], 1), (602, [3e38, 1e38], 3), (8, [-1.0, 0.0], 1), (700, [0.0, 0.0], 4), (9, [0.25, 0.25], 5)]
    assert mined(spark, rows, tmp_path) == model(rows) != []


def test_empty_table(spark, tmp_path):
    assert mined(spark, [], tmp_path) == []


def test_bounds_hold_every_score():
    rng = np.random.default_rng(4)
    x = np.floor(40 * rng.normal(size=(3000, 13))).astype(np.int64)
    centroids = N.fitted(x[:500].astype(float))
    codes, rest = N.encoded(x, centroids)
    for a in x[:20]:
        anchor = N.Anchor(0, 0, 0, a, centroids, None)
        about = sum(t[c].astype(np.int64) for t, c in zip(anchor.tables, codes.T, strict=True))
        score = (x * a).sum(1)
        assert (np.abs(score - about) <= rest * anchor.norm).all()
        assert (rest * anchor.norm).mean() < score.std()  # narrow enough to be of use


def test_most_rows_are_never_scored(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    centroids = N.fitted(x[:4096].astype(float))
    codes, rest = N.encoded(x, centroids)
    batch = N.pa.record_batch({"uid": np.arange(len(x)), "vec_id": np.arange(len(x)), "label": np.zeros(len(x), np.int32), "rest": rest, "v": [r.tobytes() for r in x], "codes": [c.tobytes() for c in codes]})
    scored = []
    exact = N._exact
    monkeypatch.setattr(N, "_exact", lambda a, b: scored.append(len(a)) or exact(a, b))
    anchor = N.Anchor(-1, 0, 0, x[0], centroids, None)
    for at in range(0, len(x), 2000):
        anchor.meet(N.Rows(batch, np.arange(at, at + 2000), 64, len(centroids)), True)
    assert anchor.best[0][0].tolist() == np.sort((x * x[0]).sum(1))[::-1][:5].tolist() and sum(scored) < 0.35 * len(x)


def test_grid_follows_the_work():
    assert N.grid(0, 0, 200) == (1, 1)
    assert N.grid(10_256, 103, 211) == (17, 1)  # small tables do not fill every task with a few rows
    strips, bands = N.grid(5_000_000, 50_000, 200)
    assert strips * bands >= 200 and bands <= 3
    strips, bands = N.grid(10**9, 10**7, 1000)
    assert strips * bands * N._TILE >= 10**16 and 10**7 / bands <= N._BAND
