"""Claims and sentences whose text many rows repeat are read once for each different text."""

import datetime

import pytest
from pyspark.sql import functions as F
from tessera.functions.text import with_claim_words
from tessera.operators import evidence as E


def claims(spark, traces):
    texts = ["Keep shipping logs for 30 days.", "Keep shipping logs for 90 days.", "You must not keep shipping logs for 30 days."]
    rows = [(t, k, f"{t}/{k}", k, "business", "policy", texts[k], datetime.date(2025, 1, 1 + k), 0.5, 0.5, "1.0", "active", None, "Logs", "") for t in range(traces) for k in range(3)]
    return with_claim_words(spark.createDataFrame(rows, "trace_id int, seq int, claim_id string, doc_id long, domain string, authority string, claim string, effective date, confidence double, relevance double, version string, status string, supersedes long, title string, section string"), "claim")


def test_pairs_of_texts_are_compared_once(spark, monkeypatch):
    compared, inner = [], E._contradictions
    monkeypatch.setattr(E, "_contradictions", lambda pairs: compared.append(pairs.count()) or inner(pairs))
    # Columns that the operator does not know, such as the engine's text, are left alone.
    more = claims(spark, 50).withColumns({"text": F.lit("passage"), "score": F.lit(0.1)})
    got = E.detect_conflicts(more, F.lit("2026-01-01").cast("date")).groupBy("kind", "subject").count().collect()
    assert compared == [3] and {r.kind: r["count"] for r in got}.keys() == {"numeric", "polarity"} and all(r["count"] == 50 for r in got)


@pytest.mark.parametrize("name", ["measurements", "measured_orders"])
def test_sentences_are_grouped_before_they_are_measured(spark, name):
    from tessera.plans.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = plan[max(k for k, line in enumerate(plan) if "Aggregate [" in line) + 1 :]
    assert any("regexp_extract_all" in line for line in plan) and not any("regexp_extract_all" in line for line in below)
