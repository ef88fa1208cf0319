"""The near-dedup stage against brute force over five-word shingles."""

import random

import corpus_pipeline
import pytest

from tests.conftest import DATA
from tests.llm.test_operators import odd  # noqa: F401


def shingles(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}


def kept(rows):
    """The smallest id of each component of likeness 0.8 or more."""
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return sorted(i for i in up if find(i) == i)


def planted():
    """Texts of 100 words with one, two and many words changed, a chain, short and empty ones."""
    rng, rows = random.Random(5), []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        rows.append(base)
        for at in ([50], [20, 80], [30, 60], [10, 30, 50, 70, 90]):
            rows.append([f"x{rng.randrange(5000)}" if k in at else w for k, w in enumerate(base)])
        moved = list(base)
        for at in (5, 15, 25, 35, 45, 55):  # each step is near the last, the end is far from the base
            moved = [f"y{rng.randrange(5000)}" if k == at else w for k, w in enumerate(moved)]
            rows.append(list(moved))
    return [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, ""), (901, None), (902, "two words"), (903, "two words"), (904, "two others")]


@pytest.mark.parametrize("table", ["planted", "documents"])
def test_stage_leaves_one_of_each_group(spark, table):
    docs = spark.createDataFrame(planted(), "doc_id long, text string") if table == "planted" else spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect())
    assert got == kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark, odd):  # noqa: F811
    out = corpus_pipeline.simhash_near_dedup(spark, odd, "")
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == odd.columns and ids.count(None) == 2 and len(set(ids)) == len(ids) - 1
    assert corpus_pipeline.simhash_near_dedup(spark, odd.where("false"), "").count() == 0
