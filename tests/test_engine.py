"""The engine on a small corpus of our own with planted contradictions, against plain-Python models where steps are sequential."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.functions import text as T
from tessera.operators import coordination as C
from tessera.operators import knowledge as K
from tessera.operators import retrieval as R
from tessera.operators import understanding as U
from tessera.plans.engine import Engine
from tessera.sources.corpus import SCHEMA, load_corpus, typed_documents, valid_documents
from tessera.streaming.ingest import start_ingest

from tests.conftest import DATA

ROWS = [
    ("t1", "technical", "Latency Guide", "Begin latency triage by checking the main dashboard. Logs are retained for 90 days in the index. Deploy the service with a canary in production.", "ops", "runbook", "1.0", "2025-01-10", None, "active", ["api"]),
    ("t2", "technical", "Deployment Runbook", "Deploy a new microservice through the pipeline. One reviewer must approve the deployment. Enable verbose request tracing in production to debug latency.", "ops", "runbook", "1.0", "2025-02-10", None, "active", []),
    ("b1", "business", "Approval Standard", "The budget owner must approve a new microservice. Procurement above 25,000 EUR needs the council.", "fin", "standard", "1.0", "2025-03-10", None, "active", []),
    ("c1", "compliance", "Retention Policy", "Application logs must be purged within 30 days. Logs with personal data are retained for 30 days at most.", "ret", "policy", "2.0", "2025-06-01", "c0", "active", ["gdpr"]),
    ("c0", "compliance", "Retention Policy", "Application logs must be purged within 60 days.", "ret", "policy", "1.0", "2024-06-01", None, "active", []),
    ("c2", "compliance", "Change Policy", "Two reviewers must approve every production deployment of a microservice. You must not enable verbose request tracing in production.", "chg", "policy", "1.0", "2025-05-01", None, "active", []),
]


@pytest.fixture(scope="module")
def answers(spark):
    engine = Engine(spark, typed_documents(spark.createDataFrame(ROWS, SCHEMA)))
    asked = spark.createDataFrame([("q1", "Can I enable verbose request tracing in production?"), ("q2", "zzzz qqqq")], "trace_id string, query string")
    return engine.answer(asked, "2026-01-01")


def test_policy_beats_runbook(answers):
    found = {r.kind: r for r in answers.conflicts.where("trace_id = 'q1'").collect()}
    assert found["polarity"].winner_doc_id == "c2" and found["polarity"].loser_doc_id == "t2" and found["polarity"].decisive


def test_citations_verify_and_no_orphans(answers):
    rows = answers.audit.collect()
    assert rows and {r.outcome for r in rows} == {"verified"}
    text = {r.trace_id: r.answer for r in answers.answers.collect()}
    assert all(r.marker in text[r.trace_id] for r in rows)


def test_pruned_citations(spark, answers):
    from tessera.operators.evidence import prune_citations

    prose = spark.createDataFrame([("q1", "only [1] is used")], "trace_id string, answer string")
    none = answers.conflicts.where("false")
    assert [r.marker for r in prune_citations(answers.citations, prose, none).collect()] == ["[1]"]
    silent = spark.createDataFrame([("q1", "nothing")], "trace_id string, answer string")
    assert prune_citations(answers.citations, silent, none).count() == answers.citations.count()


def test_out_of_domain_abstains(answers):
    row = {r.trace_id: r for r in answers.answers.collect()}["q2"]
    assert row.abstained and row.confidence == 0.0


def test_superseded_is_hidden(answers):
    assert answers.passages.where("doc_id = 'c0'").count() == 0


def test_transcript_is_totally_ordered(answers):
    for trace in ("q1", "q2"):
        n = [r.sequence for r in answers.messages.where(F.col("trace_id") == trace).orderBy("sequence").collect()]
        assert n == list(range(1, len(n) + 1))


def test_feedback_moves_weights_within_bounds(spark):
    engine = Engine(spark, typed_documents(spark.createDataFrame(ROWS[:3], SCHEMA)))
    routed = spark.createDataFrame([(k, "technical", True, False) for k in range(30)] + [(0, "compliance", False, True)], "seq int, domain string, selected boolean, expected boolean")
    agents = spark.createDataFrame([(0, "technical", 1.0, False, False), (1, "business", 0.0, False, False), (2, "compliance", 1.0, True, False)], "seq int, domain string, rating double, failed boolean, abstained boolean")
    learnt = engine.apply_feedback(routed, agents)
    assert learnt.routing_weights["technical"] == 0.6 and learnt.routing_weights["compliance"] > 1
    assert learnt.trust["technical"] > 1 > learnt.trust["business"] and learnt.trust["compliance"] == 1 and learnt.alpha["business"] < 1
    assert engine.restored(learnt.state()).trust == learnt.trust


def test_empty_query_fails(spark):
    engine = Engine(spark, typed_documents(spark.createDataFrame(ROWS[:2], SCHEMA)))
    with pytest.raises(Exception, match="empty query"):
        engine.plan(spark.createDataFrame([("q", "  ")], "trace_id string, query string"))[0].collect()


def _stem(t):
    for suffix, put in (("ies", "y"), ("sses", ""), ("ing", ""), ("ed", ""), ("s", "")):
        if t.endswith(suffix) and len(t) > len(suffix) + 2:
            return t[: -len(suffix)] + put
    return t


def test_stem_model(spark):
    words = ["process", "processes", "processing", "policies", "ties", "logs", "gas", "approved", "need", "red", "keeping", "ring", "bus"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in got} == {w: _stem(w) for w in words}


def test_normalize_and_tokens(spark):
    row = spark.createDataFrame([("Été  the Re-run's  A ﬁle x",)], "t string").select(T.normalize("t").alias("n"), T.normalize_exact("t").alias("x"), T.tokens("t").alias("w")).first()
    assert row.n.startswith("ete the re-run's a") and row.x == "ete the re-run's a file x" and row.w[:2] == ["ete", "re-run'"]


def test_legacy_numbers_fall_apart(spark):
    df = spark.createDataFrame([("Spend above 25,000 EUR.",)], "s string")
    values = lambda legacy: [m.value for m in T.with_measurements(df, "s", legacy_numbers=legacy).first().measurements]
    assert values(False) == [25000.0] and values(True) == [25.0, 0.0]


def test_mmr_model(spark):
    rng = np.random.default_rng(5)
    vectors, score = rng.normal(size=(9, 4)), rng.random(9)
    rows = spark.createDataFrame([(1, k, float(score[k]), vectors[k].tolist()) for k in range(9)], "q int, id int, rrf double, vector array<double>").withColumn("params", R.params(top_k=5, mmr_lambda=0.6))
    got = [r.id for r in R.diversify(R.ranked(rows, ["q"], "rrf", ["id"], "fused_rank"), ["q"], ["id"]).orderBy("pick").collect()]
    scaled, unit, taken = (score - score.min()) / np.ptp(score), vectors / np.linalg.norm(vectors, axis=1)[:, None], []
    order = sorted(range(9), key=lambda k: (-score[k], k))
    while len(taken) < 5:
        best = max((k for k in order if k not in taken), key=lambda k: 0.6 * scaled[k] - 0.4 * max((unit[k] @ unit[j] for j in taken), default=0))
        taken.append(best)
    assert got == taken


def test_ingest_is_idempotent_and_orderless(spark):
    docs = typed_documents(spark.createDataFrame(ROWS, SCHEMA))
    a, b = docs.where("doc_id <> 'c1'"), docs.where("doc_id = 'c1'")
    once = K.ingest(a, b)
    status = lambda df: {r.doc_id: r.status for r in df.collect()}
    assert status(once) == status(K.ingest(once, b)) == status(K.ingest(b, a)) and status(once)["c0"] == "superseded"


def test_corpus_files_faults_and_stream(spark, tmp_path):
    import json

    names = SCHEMA.replace(" array<string>", " string").replace(" string", "").split(", ")
    for domain in ("technical", "business", "compliance"):
        lines = [json.dumps(dict(zip(names, r))) for r in ROWS if r[1] == domain]
        (tmp_path / f"{domain}.jsonl").write_text("\n".join([*lines, ""]))
    assert load_corpus(spark, str(tmp_path)).count() == len(ROWS)
    bad = spark.createDataFrame([("x", "nowhere", "t", "text"), (None, "business", "t", " ")], "doc_id string, domain string, title string, text string")
    assert valid_documents(bad)[0].count() == 0 and valid_documents(bad)[1].count() == 2
    start_ingest(spark, str(tmp_path / "*.jsonl"), str(tmp_path / "versions"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "versions" / "version=0")).count() == len(ROWS)


def test_causal_chain_stops_at_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("r", None)], "node string, parent string")
    depth = {(r.start, r.node): r.depth for r in C.causal_chain(spark, links, links.select("node")).collect()}
    assert depth[("c", "b")] == 2 and ("c", "c") in depth and len([k for k in depth if k[0] == "a"]) == 2


def test_harder_questions_get_larger_pools(spark):
    df = spark.range(1).select(*(U.retrieval_params(F.lit("requirement"), F.lit(c), F.lit(0.5), F.lit(True), F.lit(True), F.lit(1.0)).alias(n) for n, c in (("easy", 0.1), ("hard", 0.9))))
    r = df.first()
    assert r.hard.candidate_pool > r.easy.candidate_pool and r.hard.mmr_lambda < r.easy.mmr_lambda and r.easy.lexical_weight > r.easy.dense_weight


def test_registered_query_answers_every_question(spark):
    from tessera.plans.catalog import QUERIES

    asked = {str(r.item_id) for r in spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet").collect()}
    got = [r.trace_id for r in QUERIES["engine_answers"](spark, f"{DATA}/sf0.001").select("trace_id").collect()]
    assert sorted(got) == sorted(asked) and len(asked) > 10
