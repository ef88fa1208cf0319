"""Threshold joins of sets against all pairs, with frequent words, copies and odd rows."""

import random

import pytest
from tessera.operators.similarity import similar_classes, similar_pairs

SCHEMA = "id long, words array<string>"


def made(seed, n, start=0):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        size = rng.choice([1, 2, 3, 5, 8, 13, 30])
        words = {rng.choice(["the", "of", "and", f"w{rng.randint(0, 40)}"]) for _ in range(size)}
        if rows and rng.random() < 0.5:  # close to an earlier one
            words = set(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 2)):
                words ^= {f"w{rng.randint(0, 60)}"}
        rows.append((start + k, sorted(words)))
    return rows + [(start + 900, []), (start + 901, ["the", "the"]), (start + 902, ["the"])]


def brute(left, right, t, own=False):
    out = {}
    for i, v in left:
        for j, w in right:
            v_, w_ = set(v), set(w)
            if v_ and w_ and (not own or i < j) and len(v_ & w_) / len(v_ | w_) >= t:
                out[i, j] = round(len(v_ & w_) / len(v_ | w_), 9)
    return out


@pytest.mark.parametrize("t", [0.3, 0.72, 0.8, 1.0])
def test_equals_all_pairs(spark, t):
    left, right = made(1, 120), made(2, 120, 5000)
    right += [(6000 + k, v) for k, (_, v) in enumerate(left[::3])]
    got = lambda df: {(r.a, r.b): round(r.jaccard, 9) for r in df.collect()}
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (left, right))
    want = brute(left, right, t)
    assert got(similar_pairs(a, b, t)) == want and want
    assert got(similar_pairs(a, None, t)) == brute(left, left, t, True)


def test_copies_are_one_class(spark):
    rows = made(3, 80) + [(2000 + k, ["b", "a", "c"]) for k in range(300)]
    members, pairs = similar_classes(spark.createDataFrame(rows, SCHEMA), 0.72)
    of = {r.id: r["class"] for r in members.collect()}
    assert of.keys() == {i for i, _ in rows} and all(of[i] == min(j for j, w in rows if set(w) == set(v)) for i, v in rows[:90])
    names = set(of.values())
    assert {(r.a, r.b) for r in pairs.collect()} == set(brute([r for r in rows if r[0] in names], [r for r in rows if r[0] in names], 0.72, True))


def test_empty_tables_and_wrong_thresholds(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert similar_pairs(none).collect() == [] and similar_pairs(none, spark.createDataFrame(made(1, 5), SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="threshold"):
        similar_pairs(none, None, 0.0)


def test_few_pairs_are_looked_at(spark):
    """Sets of one frequent word and rare ones meet on the rare ones only."""
    rows = [(k, ["the", "of", *(f"x{k // 2}_{j}" for j in range(8))]) for k in range(2000)]
    df = similar_pairs(spark.createDataFrame(rows, SCHEMA), None, 0.8)
    assert df.count() == 1000
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "word" in plan


def test_sets_out_of_reach_leave_before_words_are_ordered(spark):
    from tessera.operators.similarity import _within_reach

    left = spark.createDataFrame([(1, ["a", "b", "c"])], "id long, words array<string>")
    right = spark.createDataFrame([(1, ["a", "b", "c", "x"]), (2, ["a", "b", "x", "y"]), (3, ["z"]), (4, ["a", "b", "c"])], "id long, words array<string>")
    assert sorted(r.id for r in _within_reach(left, right, 0.72).collect()) == [1, 4]
    assert sorted((r.a, r.b) for r in similar_pairs(left, right, 0.72).collect()) == [(1, 1), (1, 4)]
