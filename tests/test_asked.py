"""Scores made where documents lie, against plain Python."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from tessera.functions.text import tokens
from tessera.operators.asked import Asked, Best, asked_counts, best_scores, in_parts
from tessera.operators.index import query_terms
from tessera.operators.topk import best_by_blocks
from tessera.plans.catalog import QUERIES
from tessera.plans.queries_search import bm25_blocks
from tessera.sources.shared import Scratch, shared_folder

from tests.conftest import DATA


def test_neither_postings_nor_scores_are_shuffled(spark):
    plan = QUERIES["bm25_topk"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 2 * 2  # only the ranking of what is left, in two listings of the plan


@pytest.mark.parametrize("most", [4, 1000])
def test_scores_and_ties(spark, most):
    docs = [("a", k, "common word" + " rare" * (k == 17) + " other" * (k % 3)) for k in range(60)] + [("b", k, "common") for k in range(5)] + [("a", 99, ""), ("a", 100, None)]
    asked = [("q1", "common rare rare"), ("q2", "other words common"), ("q3", "nowhere"), ("q4", "")]
    units = spark.createDataFrame(docs, "domain string, doc_id long, text string").repartition(5)
    terms = query_terms(spark.createDataFrame(asked, "q string, text string"), ["q"])
    got = []
    for part in in_parts(terms, "q", most):
        a = Asked.of(part, "q")
        got += [tuple(r) for r in best_scores(asked_counts(units, a), a, part.schema["q"], 7, 5).collect()]
    held = {(r.domain, r.doc_id): Counter(r.w or []) for r in units.select("domain", "doc_id", tokens("text").alias("w")).collect()}
    wanted = {r.q: Counter(r.w) for r in spark.createDataFrame(asked, "q string, text string").select("q", tokens("text").alias("w")).collect()}
    for q, words in wanted.items():
        for d in "ab":
            here = {k: c for (x, k), c in held.items() if x == d}
            mean, n = sum(c.total() for c in here.values()) / len(here), len(here)
            df = Counter(t for c in here.values() for t in c)
            idf = {t: max(0, math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) for t in words}
            score = {k: sum(m * idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for t, m in words.items() if c[t]) for k, c in here.items()}
            want = sorted(((-round(s, 5), k) for k, s in score.items() if s > 0))[:7]
            found = sorted((-round(s, 5), k) for x, y, k, s in got if (x, y) == (q, d))
            assert found[:7] == want and len(found) <= 5 * 7


def test_first_of_many_ties_and_half_digits():
    rng = np.random.default_rng(4)
    best, rows = Best(3, 10, 2), []
    for _ in range(30):
        item, doc, score = rng.integers(0, 3, 400), rng.integers(0, 10**9, 400), rng.integers(0, 40, 400) / 1000
        rows += zip(item.tolist(), doc.tolist(), score.tolist(), strict=True)
        best.add(item, doc, score)
    item, doc, score = best.cut()
    held = set(zip(item.tolist(), doc.tolist(), score.tolist(), strict=True))
    for digit in (math.floor(35 / 10 + 0.5), math.floor(35 / 10)):  # 0.035 may go up or down
        order = {r: (-(digit if r[2] == 0.035 else math.floor(r[2] * 100 + 0.5)), r[1]) for r in rows}
        for q in range(3):
            assert set(sorted((r for r in rows if r[0] == q and r[2] > 0), key=order.get)[:10]) <= held
    assert len(held) < 100
    assert not len(Best(2, 3, 5).cut()[0])


def test_blocks_write_less_than_they_read(spark):
    """Postings, impacts and partial scores were tables once, several times the size of the documents."""
    root = Path(shared_folder(spark).removeprefix("file:"))
    written = lambda: sum(p.stat().st_size for p in root.rglob("*.parquet"))
    before = written()
    bm25_blocks(spark, f"{DATA}/sf0.01")
    assert 0 < written() - before < Path(f"{DATA}/sf0.01/documents.parquet").stat().st_size


@pytest.mark.parametrize("first", [1, 4])
def test_blocks_equal_scoring_everything(spark, first):
    """A common and a rare word, ties, copies: the same first ones, and few of the common word's postings read."""
    docs = [("a", k, "common " * (1 + k % 4) + f"filler{k % 7} " * (k % 9) + (" rare" if k % 50 == 3 else "")) for k in range(2000)] + [("b", k, "common copy") for k in range(300)]
    units = spark.createDataFrame(docs, "domain string, doc_id long, text string")
    terms = query_terms(spark.createDataFrame([(1, "common rare"), (2, "copy"), (3, "nowhere")], "q int, text string"), ["q"])
    asked, scratch, made = Asked.of(terms, "q"), Scratch(spark, tidy=False), []
    counts = scratch.table(asked_counts(units, asked), "counts")
    stored = lambda df: made.append(0) or scratch.table(df, f"t{len(made)}")
    few, read = best_by_blocks(counts, asked, terms.schema["q"], 10, 5, stored, first=first)
    ranked = lambda df: [sorted((-round(r.lexical, 5), r.doc_id) for r in df.where(f"q = {q} AND domain = '{d}'").collect())[:10] for q in (1, 2, 3) for d in "ab"]
    assert ranked(few) == ranked(best_scores(counts, asked, terms.schema["q"], 10, 5))
    assert 0 < read["joined"] < (0.5 if first == 4 else 1) * read["matching"]  # all of domain b ties
