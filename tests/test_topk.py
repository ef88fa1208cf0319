"""Block-bounded BM25 against scoring everything: equal results, fewer rows joined."""

from collections import Counter

import pytest
from tessera.operators import index as I
from tessera.operators.topk import ImpactIndex
from tessera.plans.catalog import QUERIES
from tessera.plans.queries_search import bm25_blocks
from tessera.sources.shared import Scratch

from tests.conftest import DATA


def rows_of(df):
    return Counter(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def test_equals_bm25_topk_and_joins_fewer_rows(spark):
    sf = f"{DATA}/sf0.01"
    top, counts = bm25_blocks(spark, sf)
    assert rows_of(top.select("item_id", "domain", "doc_id", "score", "rank")) == rows_of(QUERIES["bm25_topk"](spark, sf))
    assert 0 < counts["joined"] < 0.95 * counts["matching"]  # texts of some thirty words of about one weight: little can be ruled out


def test_short_queries_join_few_rows(spark):
    """Two words, a common and a rare one: most postings of the common one cannot count."""
    docs = [("a", k, "common " * (1 + k % 4) + f"filler{k % 7} " * (k % 9) + (" rare" if k % 50 == 3 else "")) for k in range(2000)]
    units, keys, scratch, made = spark.createDataFrame(docs, "domain string, doc_id long, text string"), ["domain", "doc_id"], Scratch(spark), []
    stored = lambda df: made.append(0) or scratch.table(df, f"t{len(made)}")
    post = stored(I.postings(units, keys))
    lens = stored(I.lengths(post, units, keys))
    asked = spark.createDataFrame([("q", "a", "common", 1), ("q", "a", "rare", 1)], "q string, domain string, term string, qtf long")
    top, counts = ImpactIndex.build(post, lens, keys, stored).top(asked, ["q"], 10, stored)
    from tessera.operators.retrieval import ranked

    whole = ranked(I.bm25(asked, post, lens, keys, ["q"]), ["q", "domain"], "lexical", ["doc_id"], "rank").where("rank <= 10")
    assert [r.doc_id for r in top.orderBy("rank").collect()] == [r.doc_id for r in whole.orderBy("rank").collect()]
    assert counts["joined"] < 0.2 * counts["matching"]


@pytest.mark.parametrize("first", [1, 3])
def test_ties_rare_terms_and_unknown_ones(spark, first):
    docs = [("a", k, "common word" + (" rare" if k == 17 else "") + (" other" * (k % 3))) for k in range(60)] + [("b", k, "common") for k in range(5)] + [("a", 99, "")]
    units, keys, scratch = spark.createDataFrame(docs, "domain string, doc_id long, text string"), ["domain", "doc_id"], Scratch(spark)
    made = []
    stored = lambda df: made.append(0) or scratch.table(df, f"t{len(made)}")
    post = stored(I.postings(units, keys))
    lens = stored(I.lengths(post, units, keys))
    asked = spark.createDataFrame([("q1", "a", "common", 1), ("q1", "a", "rare", 2), ("q2", "a", "other", 1), ("q2", "b", "common", 1), ("q3", "a", "nowhere", 1)], "q string, domain string, term string, qtf long")
    top, counts = ImpactIndex.build(post, lens, keys, stored, block=4).top(asked, ["q"], 7, stored, first=first)
    from tessera.operators.retrieval import ranked

    whole = ranked(I.bm25(asked, post, lens, keys, ["q"]), ["q", "domain"], "lexical", ["doc_id"], "rank").where("rank <= 7")
    got = [(r.q, r.domain, r["rank"], r.doc_id, round(r.lexical, 9)) for r in top.collect()]
    assert sorted(got) == sorted((r.q, r.domain, r["rank"], r.doc_id, round(r.lexical, 9)) for r in whole.collect()) and counts["joined"] <= counts["matching"]


def test_no_documents_and_no_questions(spark):
    keys, scratch, made = ["domain", "doc_id"], Scratch(spark), []
    stored = lambda df: made.append(0) or scratch.table(df, f"t{len(made)}")
    units = spark.createDataFrame([], "domain string, doc_id long, text string")
    post = I.postings(units, keys)
    top, counts = ImpactIndex.build(post, I.lengths(post, units, keys), keys, stored).top(spark.createDataFrame([], "q string, domain string, term string, qtf long"), ["q"], 3, stored)
    assert top.collect() == [] and counts == {"joined": 0, "matching": 0}
