"""Substring dedup where one doc_id has rows of equal words but other white space, copies and other texts."""

import hashlib
import random

import pytest
from tessera.llm.substrings import dedup_substrings

SCHEMA = "doc_id long, text string"


def model(rows, length=50):
    """Rows by brute force: windows on the input, a smaller id anywhere removes."""
    least = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = t.split()
        gone = {x for k in range(len(w) - length + 1) if least[tuple(w[k : k + length])] < i for x in range(k, k + length)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def test_equal_words_with_other_white_space(spark):
    body = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"{body} y z"), (5, f"a {body} b"), (5, f"a  {body} b"), (5, f"a {body} b"), (7, f"a {body}\tb")]
    got = sorted(tuple(r) for r in dedup_substrings(spark, spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == model(rows) and [r[2] for r in got] == [0, 60, 60, 60, 62]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_ids_and_spacing(spark, seed):
    rng = random.Random(seed)
    passages = [" ".join(f"p{n}_{k}" for k in range(rng.randint(45, 120))) for n in range(6)]
    texts = [" ".join(rng.choice([*passages, "x", "y z", f"u{rng.random()}"]) for _ in range(rng.randint(1, 4))) for _ in range(25)]
    rows = []
    for _ in range(60):
        t = rng.choice(texts)
        rows.append((rng.randint(0, 20), t if rng.random() < 0.5 else t.replace(" ", rng.choice(["  ", "\n", " \t"]), rng.randint(1, 3))))
    assert sorted(tuple(r) for r in dedup_substrings(spark, spark.createDataFrame(rows, SCHEMA)).collect()) == model(rows)
