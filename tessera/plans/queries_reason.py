"""Routing, evidence, coordination, update, learning and monitoring queries; the whole engine; extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.functions.text import distinct_tokens, tokens, with_claim_words
from tessera.operators import coordination as C
from tessera.operators import evidence as E
from tessera.operators import knowledge as K
from tessera.operators import learning as N
from tessera.operators import monitoring as M
from tessera.operators import understanding as U
from tessera.plans.registry import AS_OF, DOCS, content, documents, norm, query, read, tok
from tessera.sources.shared import spread

_CUES = ", ".join("('{}', '{}', {})".format(d, c.replace("'", "''"), w) for d, cues in L.DOMAIN_CUES.items() for c, w in cues.items())
#: How the questions of the queries below begin; the rest is a benchmark text without marks and joining words, so each is one clause.
OPENINGS = (
    "How do I deploy a new microservice to production", "Who can approve the vendor contract budget", "What is the retention policy for personal data with audit evidence", "Tell me more of",
    "May I debug api latency with personal data in the logs", "Which privacy checks must a public release with customer data pass", "Why is the database slow for internal users", "How do finance people sign off urgent spend",
)
_PLAIN = r"[^A-Za-z]+|\b(?i:and|while|but)\b"
_QS = "qs AS (SELECT item_id, item_id::VARCHAR AS trace_id, [" + ", ".join(f"'{q}'" for q in OPENINGS) + f"][(item_id % {len(OPENINGS)} + 1)::INT] || ' ' || regexp_replace(text, '{_PLAIN}', ' ', 'g') AS query FROM benchmark)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, trace_id, query: a question of every benchmark text."""
    b = read(spark, sf_dir, "benchmark")
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.col("item_id") % len(OPENINGS) + 1).cast("int"))
    return b.select("item_id", F.col("item_id").cast("string").alias("trace_id"), F.concat(opening, F.lit(" "), F.regexp_replace("text", _PLAIN, " ")).alias("query"))


_CUE = f"""{_QS}, cues(domain, cue, weight) AS (VALUES {_CUES}), d(domain, place) AS (VALUES ('technical', 1), ('business', 2), ('compliance', 3)),
w AS (SELECT trace_id, query, {norm('query')} AS norm, {content('query')} AS words FROM qs),
t AS (SELECT trace_id, domain, sum(weight::DOUBLE) AS total FROM w JOIN cues ON CASE WHEN contains(cue, ' ') THEN contains(norm, cue) ELSE list_contains(words, cue) END GROUP BY ALL),
cs AS (SELECT w.trace_id, d.domain, d.place, least(1, 1 - exp(-coalesce(total, 0) / 3.2)) AS cue_score FROM w CROSS JOIN d LEFT JOIN t ON t.trace_id = w.trace_id AND t.domain = d.domain)"""


@query("cue_score", f"WITH {_CUE} SELECT trace_id, domain, round(cue_score, 6) AS cue_score FROM cs")
def cue_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.cue_scores(questions(spark, sf_dir)).select("trace_id", "domain", F.round("cue_score", 6).alias("cue_score"))


_ROUTE = f"{_CUE}, ev AS (SELECT trace_id, domain, place, cue_score, trace_id::BIGINT % 7 * place / 30.0 AS similarity FROM cs), r AS (SELECT *, CASE WHEN max(greatest(0, similarity)) OVER w > 0 THEN greatest(0, similarity) / max(greatest(0, similarity)) OVER w ELSE 0 END AS ratio FROM ev WINDOW w AS (PARTITION BY trace_id)), sc AS (SELECT *, round(least(1, 1 - (1 - cue_score) * (1 - 0.55 * ratio)), 4) AS score FROM r), rk AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY score DESC, place) - 1 AS rank, max(score) OVER (PARTITION BY trace_id) AS top FROM sc), sel AS (SELECT *, top >= 0.3 AND score >= greatest(0.3, top * 0.52) AND rank < 3 AS selected FROM rk)"


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = U.cue_scores(questions(spark, sf_dir)).select("trace_id", "domain", "cue_score")
    place = F.array_position(F.array(*map(F.lit, L.DOMAINS)), F.col("domain"))
    return U.route(cues.withColumn("similarity", F.col("trace_id").cast("long") % 7 * place / 30.0).withColumn("weight", F.lit(1.0)))


@query("noisy_or_route", f"WITH {_ROUTE} SELECT trace_id, domain, round(ratio, 6) AS ratio, score FROM sel")
def noisy_or_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).select("trace_id", "domain", F.round("ratio", 6).alias("ratio"), "score")


@query("route_select", f"WITH {_ROUTE} SELECT trace_id, domain, rank::INT AS rank FROM sel WHERE selected")
def route_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).where("selected").select("trace_id", "domain", "rank")


@query("complexity", f"WITH {_ROUTE}, n AS (SELECT trace_id, count(*) FILTER (WHERE selected) AS n FROM sel GROUP BY trace_id) SELECT trace_id, round(0.2 * least(1, greatest(0, len(regexp_extract_all(lower(query), '\\b(what|which|who|whom|whose|when|where|why|how)\\b')) - 1) / 2) + 0.2 * least(1, greatest(0, len({content('query')}) - 6) / 18) + 0.3 * least(1, greatest(0, n - 1) / 2), 3) AS complexity FROM qs JOIN n USING (trace_id)")
def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.classified(questions(spark, sf_dir), routed(spark, sf_dir)).select("trace_id", "complexity")


_META = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in L.META_TERMS) + "]"


@query("anchor_clause", f"WITH {_QS}, w AS (SELECT trace_id, list_filter({content('query')}, lambda t: NOT list_contains({_META}, t)) AS w FROM qs), m AS (SELECT trace_id, 'compliance checks apply' AS clause, list_slice(list_filter(w, lambda t, i: list_position(w, t) = i), 1, 4) AS extra FROM w) SELECT trace_id, clause || ' ' || array_to_string(extra, ' ') AS anchored FROM m")
def anchor_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("trace_id", U.anchored_clause(F.lit("compliance checks apply"), F.col("query")).alias("anchored"))


@query("retrieval_params", "SELECT i, intent, greatest(2, least(6, 4 + (c > 0.45)::INT + (c > 0.7)::INT - (NOT p)::INT))::INT AS top_k, round(CASE WHEN intent IN ('requirement', 'approval') THEN 1.35 ELSE 1 END::DOUBLE, 6) AS lexical, round(greatest(0.5, least(0.9, CASE WHEN m THEN 0.68 ELSE 0.85 END - 0.1 * c))::DOUBLE, 6) AS spread, round((0.22 * (1.25 - 0.45 * f))::DOUBLE, 6) AS floor FROM (SELECT event_id AS i, ['approval', 'diagnostic', 'definitional', 'requirement'][(event_id % 4 + 1)::INT] AS intent, (event_id % 101 / 100.0)::DOUBLE AS c, (event_id * 7 % 101 / 100.0)::DOUBLE AS f, user_id % 2 = 0 AS p, event_id % 3 = 0 AS m FROM events)")
def retrieval_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters of questions of all kinds, one an event."""
    intent = F.element_at(F.array(*map(F.lit, ("approval", "diagnostic", "definitional", "requirement"))), (F.col("event_id") % 4 + 1).cast("int"))
    v = read(spark, sf_dir, "events").select(F.col("event_id").alias("i"), intent.alias("intent"), (F.col("event_id") % 101 / 100).alias("c"), (F.col("event_id") * 7 % 101 / 100).alias("f"), (F.col("user_id") % 2 == 0).alias("p"), (F.col("event_id") % 3 == 0).alias("m"))
    x = v.select("i", "intent", U.retrieval_params(F.col("intent"), F.col("c"), F.col("f"), F.col("p"), F.col("m"), F.lit(1.0)).alias("x"))
    return x.select("i", "intent", F.col("x.top_k").alias("top_k"), F.round("x.lexical_weight", 6).alias("lexical"), F.round("x.mmr_lambda", 6).alias("spread"), F.round("x.min_score", 6).alias("floor"))


_CTX = ", ".join(f"({n}, '{d}', '{v}', '{c}')" for n, (d, v, cues) in enumerate(L.CONTEXT_CUES) for c in cues)


@query("context_extract", f"WITH {_QS}, c(n, dimension, value, cue) AS (VALUES {_CTX}), h AS (SELECT trace_id, dimension, value, n, strpos({norm('query')}, cue) AS pos FROM qs, c) SELECT trace_id, dimension, arg_min(value, pos * 1000 + n) AS value FROM h WHERE pos > 0 GROUP BY ALL")
def context_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("trace_id", F.explode(C.context("query")).alias("dimension", "value"))


@query("expansion_terms", f"WITH {_QS}, c(n, dimension, value, cue) AS (VALUES {_CTX}), h AS (SELECT trace_id, dimension, arg_min(value, strpos({norm('query')}, cue) * 1000 + n) AS value FROM qs, c WHERE strpos({norm('query')}, cue) > 0 GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY dimension) AS place FROM h), x(dimension, value, term_no, term) AS (VALUES " + ", ".join(f"('{d}', '{v}', {n}, '{t}')" for d, v, ts in L.CONTEXT_EXPANSIONS for n, t in enumerate(ts)) + "), r AS (SELECT trace_id, term, row_number() OVER (PARTITION BY trace_id ORDER BY place, term_no) AS n FROM p JOIN x USING (dimension, value)) SELECT trace_id, string_agg(term, '|' ORDER BY n) AS terms FROM r WHERE n <= 4 GROUP BY trace_id")
def expansion_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = context_extract(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy("dimension")))
    return C.expansion_terms(f, ["trace_id"]).select("trace_id", F.array_join("terms", "|").alias("terms"))


@query("blackboard_best", "SELECT event_type, (user_id % 3)::BIGINT AS author, arg_max(event_id, (round(least(1.0, value / 500), 4), event_id)) AS event_id FROM events GROUP BY ALL")
def blackboard_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("author"), "event_id", F.round(F.least(F.lit(1.0), F.col("value") / 500), 4).alias("confidence"), F.col("event_id").alias("seq"))
    return C.best_facts(e, ["event_type", "author"], value="event_id").select("event_type", "author", "event_id")


@query("provenance_chain", "WITH RECURSIVE m AS (SELECT conv_id || '/' || turn AS node, CASE WHEN turn > 0 THEN conv_id || '/' || (turn - 1) END AS parent FROM conversations), w AS (SELECT node AS start, node, 0 AS depth FROM m UNION ALL SELECT w.start, m.parent, depth + 1 FROM w JOIN m USING (node) WHERE m.parent IS NOT NULL) SELECT start, node, depth::INT AS depth FROM w")
def provenance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("/"), t.cast("string"))
    links = read(spark, sf_dir, "conversations").select(node(F.col("turn")).alias("node"), F.when(F.col("turn") > 0, node(F.col("turn") - 1)).alias("parent"))
    return C.causal_chain(spark, links, links.select("node"))


@query("message_transcript", "SELECT conv_id, string_agg(printf('%03d %s -> %s [%s]', n, role, 'peer', 'turn'), chr(10) ORDER BY n) AS transcript FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def message_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace_id"), "turn", F.col("role").alias("sender"), F.lit("peer").alias("recipient"), F.lit("turn").alias("type"))
    return C.rendered(C.sequenced(m, ["turn"])).withColumnRenamed("trace_id", "conv_id")


@query("upsert_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.latest(read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("upsert_documents", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE lang END AS lang, n_chars FROM documents) GROUP BY lang")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    new = d.where("doc_id % 10 = 0").withColumn("lang", F.lit("new"))
    return K.upsert(K.upsert(d, new), new).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("retire_superseded", f"WITH {DOCS}, old AS (SELECT DISTINCT supersedes AS doc_id FROM docs WHERE supersedes IS NOT NULL) SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM old) THEN 'superseded' ELSE 'active' END AS status FROM docs")
def retire_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.retire(documents(spark, sf_dir).withColumn("status", F.lit("active"))).select("doc_id", "status")


@query("supersession_pairs", f"WITH {DOCS} SELECT a.doc_id AS newer, b.doc_id AS older FROM docs a JOIN docs b ON a.supersedes = b.doc_id")
def supersession_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    old = d.select(F.col("doc_id").alias("older"))
    return d.join(old, F.col("supersedes") == F.col("older")).select(F.col("doc_id").alias("newer"), "older")


_MARKS = ["[" + ", ".join(f"'{w}'" for w in ws) + "]" for ws in (L.OBLIGATION_MARKERS, L.PROCEDURAL_MARKERS)]


@query("claim_salience", f"WITH q AS (SELECT item_id, list_distinct({tok('text')}) AS q FROM benchmark), d AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id, list_distinct({tok('text')}) AS w, {content('text')} AS r FROM documents) SELECT doc_id, CASE WHEN len(w) = 0 OR len(q) = 0 THEN 0 ELSE round(least(1, 0.55 * least(1, 2.2 * (0.72 * len(list_intersect(w, q)) / len(q))) + 0.26 * list_has_any(r, {_MARKS[0]})::INT + 0.10 * list_has_any(r, {_MARKS[1]})::INT), 4) END AS salience FROM d JOIN q USING (item_id)")
def claim_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    n = b.agg(F.count("*").alias("n"))
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).crossJoin(F.broadcast(n)).select("doc_id", (F.col("doc_id") % F.col("n")).alias("item_id"), distinct_tokens("text").alias("t")).select("doc_id", "item_id", F.col("t.stems").alias("w"), F.col("t.plain").alias("r"))
    q = b.select("item_id", F.array_distinct(tokens("text")).alias("q"))
    return d.join(q, "item_id").select("doc_id", E.salience(F.col("w"), F.col("r"), F.col("q"), F.array().cast("array<string>"), F.lit("requirement"), F.lit(False)).alias("salience"))


def _claim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as tables of integers: conversations' turns with made-up scores."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("trace_id"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("claim_id"), F.element_at(F.array(*map(F.lit, L.DOMAINS)), (F.col("turn") % 2 + 1).cast("int")).alias("domain"),
                    F.col("turn").alias("doc_id"), F.col("text").alias("claim"), F.col("turn").alias("seq"), (F.col("turn") % 2).alias("rank"), F.round(F.pmod(F.col("conv_id") * 7 + F.col("turn") * 13, F.lit(100)) / 100, 2).alias("topicality"), F.round(F.pmod(F.col("conv_id") * 3 + F.col("turn") * 5, F.lit(10)) / 10, 1).alias("confidence"), F.lit(0).alias("span_start"), F.length("text").alias("span_end"))


_CLAIMS = "c AS (SELECT conv_id AS trace_id, conv_id || '/' || turn AS claim_id, ['technical', 'business'][(turn % 2 + 1)::INT] AS domain, turn AS seq, turn % 2 AS rank, round((conv_id * 7 + turn * 13) % 100 / 100, 2) AS topicality, round((conv_id * 3 + turn * 5) % 10 / 10, 1) AS confidence FROM conversations), f AS (SELECT *, max(topicality) OVER (PARTITION BY trace_id, domain) AS best FROM c), s AS (SELECT *, row_number() OVER (PARTITION BY trace_id, domain ORDER BY topicality DESC, seq) AS shown FROM f WHERE topicality >= greatest(0.4, 0.55 * best) OR topicality = best OR seq = 3), k AS (SELECT * FROM s WHERE shown <= 4 OR seq = 3)"


@query("topicality_select", f"WITH {_CLAIMS} SELECT trace_id, claim_id, shown::INT AS shown FROM k")
def topicality_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claim_rows(spark, sf_dir)
    return E.shown_claims(c, c.where("seq = 3")).select("trace_id", "claim_id", "shown")


@query("citation_markers", f"WITH {_CLAIMS} SELECT trace_id, claim_id, '[' || row_number() OVER (PARTITION BY trace_id ORDER BY rank, shown, seq) || ']' AS marker FROM k")
def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claim_rows(spark, sf_dir)
    shown = E.shown_claims(c, c.where("seq = 3"))
    return E.citations(shown, c.where("false")).select("trace_id", "claim_id", "marker")


@query("answer_confidence", f"WITH {_CLAIMS}, a AS (SELECT trace_id, sum(confidence * confidence) AS sq, sum(confidence) AS t, count(DISTINCT seq) AS d FROM k GROUP BY trace_id) SELECT trace_id, CASE WHEN t > 0 THEN round(greatest(0, least(1, 0.82 * sq / t + 0.18 * least(1, d / 3))), 4) ELSE 0 END AS confidence FROM a")
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claim_rows(spark, sf_dir)
    shown = E.shown_claims(c, c.where("seq = 3"))
    none = spark.createDataFrame([], "trace_id long, decisive boolean")
    return E.confidence_of_answer(shown, none, c.select("trace_id", F.lit(False).alias("degraded")).distinct()).select("trace_id", "confidence")


@query("citation_audit", "SELECT outcome, count(*) AS n FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN CASE WHEN trim(regexp_replace(text[2:11], '\\s+', ' ', 'g')) = trim(regexp_replace(text[1:10], '\\s+', ' ', 'g')) THEN 'verified' ELSE 'span mismatch' END WHEN 2 THEN 'quote absent' ELSE 'document missing' END AS outcome FROM documents) GROUP BY outcome")
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 4
    cited = d.select(F.when(kind == 3, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), F.when(kind == 2, F.lit("¤ no such words ¤")).otherwise(F.substring("text", 1, 10)).alias("quote"), F.when(kind == 1, 1).otherwise(0).alias("span_start"), F.when(kind == 1, 11).otherwise(10).alias("span_end"))
    return E.audit_citations(cited, d.select("doc_id", "text")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("metrics_summary", "WITH e AS (SELECT event_type, round(value, 2) AS v FROM events), o AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY v) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM e) SELECT event_type, any_value(n)::BIGINT AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, max(v) AS greatest, max(v) FILTER (WHERE r = greatest(1, least(n, round_even(0.95 * n + 0.5, 0)))) AS p95 FROM o GROUP BY event_type")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_type", F.round("value", 2).alias("v"))
    return M.summary(e, ["event_type"], "v").select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "greatest", "p95")


@query("percentile_nearest_rank", "WITH o AS (SELECT label, vec_id AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT label, max(v) FILTER (WHERE r = greatest(1, least(n, round_even(0.9 * n + 0.5, 0)))) AS p90 FROM o GROUP BY label")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nearest_rank(read(spark, sf_dir, "embeddings"), ["label"], "vec_id", 90, "p90")


@query("routing_prf1", "WITH s AS (SELECT (quality = 1)::INT AS pq, (toxic = 1)::INT AS pt, (doc_id % 2 = 0)::INT AS eq, (doc_id % 5 = 0)::INT AS et FROM labels), r AS (SELECT pq * eq + pt * et AS b, pq + pt AS p, eq + et AS e, (pq = eq AND pt = et)::INT AS x FROM s WHERE eq + et > 0), a AS (SELECT count(*) AS labelled, avg(x) AS accuracy, avg(CASE WHEN p > 0 THEN b / p ELSE 0 END) AS precision, avg(b / e) AS recall FROM r) SELECT labelled, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM a")
def routing_prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = lambda *pairs: F.filter(F.array(*(F.when(c, n) for c, n in pairs)), lambda x: x.isNotNull())
    rows = read(spark, sf_dir, "labels").select(keep((F.col("quality") == 1, "q"), (F.col("toxic") == 1, "t")).alias("predicted"), keep((F.col("doc_id") % 2 == 0, "q"), (F.col("doc_id") % 5 == 0, "t")).alias("expected"))
    out = M.routing_quality(rows)
    return out.select("labelled", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query("per_domain_stats", f"WITH {DOCS} SELECT domain, count(*) AS documents, count(DISTINCT lang) AS languages, round(avg(len(text)), 6) AS mean_chars, max(version_no) AS version_no FROM docs GROUP BY domain")
def per_domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("languages"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.max("version_no").alias("version_no"))


@query("kb_stats_rollup", f"WITH {DOCS}, old AS (SELECT DISTINCT supersedes AS o FROM docs WHERE supersedes IS NOT NULL), p AS (SELECT domain, len(regexp_extract_all(text, '\\n')) + 1 AS passages, (doc_id NOT IN (SELECT o FROM old))::INT AS active FROM docs) SELECT domain, count(*)::BIGINT AS documents, sum(active)::BIGINT AS active, sum(passages)::BIGINT AS passages FROM p GROUP BY ROLLUP (domain)")
def kb_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = K.retire(documents(spark, sf_dir).withColumn("status", F.lit("active")))
    return K.stats(d, d.select("domain", F.explode(F.split("text", "\n"))))


@query("feedback_fold", "WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN value > 100 THEN 0.08 WHEN value > 40 THEN 0.02 ELSE -0.08 END::DOUBLE AS step FROM events), w AS (SELECT user_id, n, greatest(0.6, least(1.5, 1 + step)) AS v FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, greatest(0.6, least(1.5, w.v + e.step)) FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1) SELECT user_id, round(arg_max(v, n), 6) AS value FROM w GROUP BY user_id")
def feedback_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("value") > 100, 0.08).when(F.col("value") > 40, 0.02).otherwise(-0.08).alias("step"))
    return N.folded(e, ["user_id"], "step", ["ts", "event_id"]).select("user_id", F.round("value", 6).alias("value"))


_ROUNDS = 4
_FOLD = ", ".join(f"CASE WHEN ok THEN w{k} ELSE greatest(0.6, least(1.5, w{k} + CASE WHEN e{k} AND NOT b{k} THEN 0.08 WHEN b{k} AND NOT e{k} THEN -0.08 WHEN b{k} THEN 0.02 ELSE 0 END)) END::DOUBLE AS w{k}" for k in (1, 2, 3))


def _each(text: str) -> str:
    return ", ".join(text.replace("@", str(k)) for k in (1, 2, 3))


@query("replay_accuracy", f"WITH RECURSIVE {_ROUTE}, st AS (SELECT row_number() OVER (ORDER BY trace_id::BIGINT) AS k, {_each('max((1 - (1 - cue_score) * (1 - 0.55 * ratio))::DOUBLE) FILTER (WHERE place = @) AS s@, @ - 1 IN (trace_id::BIGINT % 3, trace_id::BIGINT // 3 % 3) AS e@')} FROM sel GROUP BY trace_id), many AS (SELECT count(*) AS q FROM st), fold AS (SELECT 0::BIGINT AS n, {_each('1::DOUBLE AS w@')}, false AS ok UNION ALL "
       f"SELECT n + 1, {_FOLD}, ok FROM (SELECT *, {' AND '.join(f'b{k} = e{k}' for k in (1, 2, 3))} AS ok FROM (SELECT * EXCLUDE (ok), {_each('top >= 0.3 AND c@ >= greatest(0.3, top * 0.52) AS b@')} FROM (SELECT *, greatest(c1, c2, c3) AS top FROM (SELECT *, {_each('round(least(1, s@ * w@), 4) AS c@')} FROM fold, many JOIN st ON st.k = fold.n % many.q + 1 WHERE fold.n < {_ROUNDS} * many.q))))) "
       f"SELECT ((n - 1) // q + 1)::INT AS round, round(avg(ok::INT), 4) AS accuracy, round(arg_max(w1, n), 6) AS technical, round(arg_max(w2, n), 6) AS business, round(arg_max(w3, n), 6) AS compliance FROM fold, many WHERE n > 0 GROUP BY 1")
def replay_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing learnt over every question, each of which is routed with what those before it have left."""
    item, place = F.col("trace_id").cast("long"), F.array_position(F.array(*map(F.lit, L.DOMAINS)), F.col("domain")) - 1
    labelled = routed(spark, sf_dir).select(item.alias("seq"), "domain", "similarity", "cue_score", ((place == item % 3) | (place == F.floor(item / 3) % 3)).alias("expected"))
    out = N.replay(labelled, _ROUNDS)
    return out.select("round", "accuracy", *(F.round(d, 6).alias(d) for d in L.DOMAINS))


def replaced_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two claims of one wording for every document that supersedes another: the old one's and its own."""
    d = K.retire(documents(spark, sf_dir).withColumn("status", F.lit("active"))).select("doc_id", "domain", "authority", "effective", F.col("version_no").cast("string").alias("version"), "status", "supersedes", "source")
    new = d.where("supersedes IS NOT NULL").select(F.col("doc_id").alias("trace_id"), F.lit(1).alias("seq"), "*")
    old = d.drop("supersedes").join(new.select("trace_id", F.col("supersedes").alias("doc_id")), "doc_id").withColumns({"seq": F.lit(2), "supersedes": F.lit(None).cast("long")})
    rows = new.unionByName(old.select(*new.columns)).withColumns({"claim": F.lit("Shipping logs are kept by the archive team."), "claim_id": F.col("doc_id").cast("string"), "confidence": F.lit(0.5), "relevance": F.lit(0.5), "title": F.lit("Logs"), "section": F.lit("")})
    return with_claim_words(rows, "claim")


def superseding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.detect_conflicts(replaced_claims(spark, sf_dir), F.lit(AS_OF).cast("date"))


_STANDING = f"round(0.34 * [1.0, 0.85, 0.65, 0.4][list_position({'[' + ', '.join(repr(a) for a in L.AUTHORITY_WEIGHTS) + ']'}, authority)]::DOUBLE + 0.26 * [0.7, 0.85, 1.0][list_position({'[' + ', '.join(repr(d) for d in L.DOMAINS) + ']'}, domain)]::DOUBLE + 0.22 * pow(0.5, greatest(0, date_diff('day', effective, DATE '{AS_OF}')) / 540.0) + 0.09, 4)"
_REPLACED = f"{DOCS}, sc AS (SELECT doc_id, supersedes, {_STANDING} AS score FROM docs), rep AS (SELECT a.doc_id AS winner, b.doc_id AS loser, round(abs(a.score - b.score), 4) AS margin FROM sc a JOIN sc b ON a.supersedes = b.doc_id)"


@query("adjudicate", f"WITH {_REPLACED} SELECT 'supersession' AS kind, winner, loser, margin FROM rep")
def adjudicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new versions of every document: the active one wins, whatever the scores, which give the margin."""
    return superseding(spark, sf_dir).select("kind", F.col("winner_doc_id").alias("winner"), F.col("loser_doc_id").alias("loser"), "margin")


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_PAIRS = f"""st AS (SELECT l_orderkey AS trace_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS seq, l_quantity::INT AS days, l_returnflag = 'R' AS banned, round(l_discount, 2) AS confidence,
  round(0.34 * [1.0, 0.85, 0.65, 0.4][l_linenumber % 4 + 1]::DOUBLE + 0.26 * [0.7, 0.85, 1.0][l_linenumber % 3 + 1]::DOUBLE + 0.22 * pow(0.5, greatest(0, date_diff('day', l_shipdate::DATE, DATE '{AS_OF}')) / 540.0) + 0.09, 4) AS score FROM lineitem),
pairs AS (SELECT a.trace_id, a.seq AS a, b.seq AS b, a.score AS a_score, b.score AS b_score, least(a.confidence, b.confidence) AS strength, CASE WHEN abs(a.days - b.days) / greatest(a.days, b.days) > 0.05 THEN 'numeric' WHEN a.banned <> b.banned THEN 'polarity' END AS kind FROM st a JOIN st b ON a.trace_id = b.trace_id AND a.seq < b.seq)"""


def statements(spark: SparkSession, sf_dir: str, documents: int | None = None) -> DataFrame:
    """A claim per line item on how long logs are kept; with `documents`, so many documents hold an order's claims."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("l_linenumber") % n + 1).cast("int"))
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", ")))
    rows = read(spark, sf_dir, "lineitem").withColumn("seq", seq).select(
        F.col("l_orderkey").alias("trace_id"), "seq", F.col("seq").cast("string").alias("claim_id"), (F.col("seq") % documents if documents else F.col("seq")).alias("doc_id"), pick(L.DOMAINS, 3).alias("domain"), pick(tuple(L.AUTHORITY_WEIGHTS), 4).alias("authority"),
        F.concat(F.when(F.col("l_returnflag") == "R", "You must not keep").otherwise("Keep"), F.lit(" shipping logs for "), F.col("l_quantity").cast("int").cast("string"), F.lit(" days.")).alias("claim"), F.col("l_shipdate").cast("date").alias("effective"), F.round("l_discount", 2).alias("confidence"),
        F.lit(0.5).alias("relevance"), F.lit("1.0").alias("version"), F.lit("active").alias("status"), F.lit(None).cast("long").alias("supersedes"), F.lit("Logs").alias("title"), F.lit("").alias("section"),
    )
    return with_claim_words(rows, "claim")


def _disputes(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = E.detect_conflicts(statements(spark, sf_dir), F.lit(AS_OF).cast("date"), None).where(F.col("kind") == kind)
    return found.select("trace_id", F.col("winner_doc_id").cast("long").alias("winner"), F.col("loser_doc_id").cast("long").alias("loser"), "margin", "decisive")


_DISPUTES = f"WITH {_PAIRS} SELECT trace_id, CASE WHEN a_score >= b_score THEN a ELSE b END AS winner, CASE WHEN a_score >= b_score THEN b ELSE a END AS loser, round(abs(a_score - b_score), 4) AS margin, round(abs(a_score - b_score), 4) >= 0.08 AS decisive FROM pairs WHERE kind = '@kind'"


@query("numeric_conflicts", _DISPUTES.replace("@kind", "numeric"))
def numeric_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _disputes(spark, sf_dir, "numeric")


@query("polarity_conflicts", _DISPUTES.replace("@kind", "polarity"))
def polarity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _disputes(spark, sf_dir, "polarity")


@query("conflicts", f"WITH {_REPLACED}, {_PAIRS} SELECT kind, count(*) AS n, count(*) FILTER (WHERE round(abs(a_score - b_score), 4) >= 0.08) AS decisive FROM pairs WHERE kind IS NOT NULL GROUP BY kind UNION ALL SELECT 'supersession', count(*), count(*) FROM rep")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions of all three kinds, and how many of them are decisive."""
    found = E.detect_conflicts(statements(spark, sf_dir), F.lit(AS_OF).cast("date"), None).select("kind", "decisive").unionByName(superseding(spark, sf_dir).select("kind", "decisive"))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("decisive").alias("decisive"))


@query("dispute_dedup", f"WITH {_PAIRS} SELECT trace_id, kind, a::VARCHAR AS left_claim, b::VARCHAR AS right_claim, strength FROM pairs WHERE kind IS NOT NULL AND a % 2 <> b % 2 QUALIFY row_number() OVER (PARTITION BY trace_id, kind ORDER BY strength DESC, a, b) = 1")
def dispute_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair that stands for each dispute, where two documents hold all claims of an order."""
    found = E.detect_conflicts(statements(spark, sf_dir, 2), F.lit(AS_OF).cast("date"), None)
    first = lambda f: f(F.col("winner_claim_id").cast("int"), F.col("loser_claim_id").cast("int")).cast("string")
    return found.select("trace_id", "kind", first(F.least).alias("left_claim"), first(F.greatest).alias("right_claim"), "strength")


@query("measured_orders", "SELECT (o_orderkey % 50) || ' weeks' AS raw, 'duration' AS family, round((o_orderkey % 50) * 7.0, 6)::DOUBLE AS base, 'order,retain' AS anchors, count(*) AS n FROM orders GROUP BY ALL")
def measured_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quantity of a sentence per order, counted."""
    from tessera.functions.text import with_measurements

    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("Retain orders for "), (F.col("o_orderkey") % 50).cast("string"), F.lit(" weeks.")).alias("s"))
    m = with_measurements(rows.groupBy("s").agg(F.count("*").alias("n")), "s").select(F.explode_outer("measurements").alias("m"), "n").where("m IS NOT NULL")
    return m.groupBy("m.raw", "m.family", F.round("m.base_value", 6).alias("base"), F.array_join("m.anchors", ",").alias("anchors")).agg(F.sum("n").alias("n"))


@query("agent_stats", f"WITH a AS (SELECT {'[' + ', '.join(repr(d) for d in L.DOMAINS) + ']'}[(user_id % 3 + 1)::INT] AS domain, event_id % 7 AS passages, event_id % 4 AS claims, value AS latency_ms, event_id % 5 = 0 AS abstained, event_id % 11 = 0 AS failed, (event_id % 100) / 100.0::DOUBLE AS top_relevance FROM events) SELECT domain, count(*) AS invocations, count(*) FILTER (WHERE abstained) AS abstentions, count(*) FILTER (WHERE failed) AS failures, round(avg(passages), 6) AS mean_passages, round(avg(claims), 6) AS mean_claims, round(avg(latency_ms), 4) AS mean_latency_ms, round(avg(top_relevance), 6) AS mean_top_relevance, round(avg((NOT abstained AND NOT failed)::INT), 6) AS contribution_rate FROM a GROUP BY domain")
def agent_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight measures of an agent, over events as records of agents."""
    e = read(spark, sf_dir, "events").select(F.element_at(F.array(*map(F.lit, L.DOMAINS)), (F.col("user_id") % 3 + 1).cast("int")).alias("domain"), (F.col("event_id") % 7).alias("passages"), (F.col("event_id") % 4).alias("claims"), F.col("value").alias("latency_ms"),
                                           (F.col("event_id") % 5 == 0).alias("abstained"), (F.col("event_id") % 11 == 0).alias("failed"), ((F.col("event_id") % 100) / 100).alias("top_relevance"))
    out = M.agent_stats(e)
    return out.select("domain", "invocations", "abstentions", "failures", *(F.round(c, 4 if c == "mean_latency_ms" else 6).alias(c) for c in out.columns[4:]))


@query("engine_answers")
def engine_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine on the documents with derived metadata and every benchmark text as a question."""
    from tessera.plans.engine import Engine

    d = documents(spark, sf_dir).withColumns({"title": F.concat(F.lit("Document "), F.col("doc_id").cast("string")), "section": F.col("source"), "version": F.col("version_no").cast("string"), "status": F.lit("active"), "tags": F.array("lang")})
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("trace_id"), F.col("text").alias("query"))
    return Engine(spark, d).answer(asked, AS_OF).answers


@query("x_star_revenue", "SELECT r_name, l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= DATE '1995-01-01' GROUP BY GROUPING SETS ((r_name, l_returnflag), (r_name), ())")
def x_star_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: a star join with grouping sets."""
    for t in ("lineitem", "orders", "customer", "nation", "region"):
        read(spark, sf_dir, t).createOrReplaceTempView(f"x_{t}")
    return spark.sql("SELECT r_name, l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM x_lineitem JOIN x_orders ON l_orderkey = o_orderkey JOIN x_customer ON o_custkey = c_custkey JOIN x_nation ON c_nationkey = n_nationkey JOIN x_region ON n_regionkey = r_regionkey WHERE o_orderdate >= DATE '1995-01-01' GROUP BY GROUPING SETS ((r_name, l_returnflag), (r_name), ())")


@query("x_sessions", "WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS began, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s")
def x_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: session windows of 30 minutes by user."""
    e = read(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "30 minutes")).agg(F.min("ts").alias("began"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).drop("session_window")


@query("x_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the stream's tumbling windows, over a whole table."""
    from tessera.streaming.ingest import windowed_counts

    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(e).withColumn("total", F.round("total", 4))
