"""Queries of updates over time: versions in buckets, points in time, online feedback, sketches by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import sketches as S
from tessera.operators.pointintime import in_force
from tessera.plans.registry import DOCS, documents, query, read
from tessera.sources.shared import Scratch
from tessera.sources.versions import Versions


@query("versioned_upsert", f"WITH {DOCS} SELECT doc_id, CASE doc_id % 20 WHEN 7 THEN 'zz' WHEN 4 THEN 'yy' ELSE lang END AS lang, CASE WHEN doc_id % 20 = 14 AND doc_id + 3 IN (SELECT doc_id FROM docs) THEN 'superseded' ELSE 'active' END AS status, len(text) AS chars FROM docs")
def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first version of the documents, then a batch with new ones, ones that no longer retire another, and some of those retired."""
    d = documents(spark, sf_dir).withColumn("status", F.lit("active"))
    store, kind = Versions(spark, f"{Scratch(spark).root}/versions"), F.col("doc_id") % 20
    store.upsert(d.where(kind != 3))
    changed = d.withColumn("lang", F.when(kind == 7, "zz").when(kind == 4, "yy").otherwise(F.col("lang"))).withColumn("supersedes", F.when(kind != 7, F.col("supersedes")))
    number = store.upsert(changed.where(kind.isin(3, 4, 7)))
    return store.read(number).select("doc_id", "lang", "status", F.length("text").alias("chars"))


@query("in_force", f"WITH {DOCS}, v AS (SELECT doc_id % 50 AS topic, effective, max(doc_id) AS in_force FROM docs GROUP BY ALL), q AS (SELECT conv_id, turn, conv_id % 50 AS topic, (DATE '2023-12-01' + ((conv_id * 37 + turn * 11) % 800)::INT)::DATE AS asked FROM conversations) SELECT q.conv_id, q.turn, q.asked, v.in_force FROM q ASOF LEFT JOIN v ON q.topic = v.topic AND q.asked >= v.effective")
def in_force_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every turn of a conversation, asked on a date of its own, the document on its topic that was in force then."""
    v = documents(spark, sf_dir).select((F.col("doc_id") % 50).alias("topic"), "effective", F.col("doc_id").alias("in_force"))
    days = F.pmod(F.col("conv_id") * 37 + F.col("turn") * 11, F.lit(800)).cast("int")
    q = read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 50).alias("topic"), F.date_add(F.lit("2023-12-01").cast("date"), days).alias("asked"))
    return in_force(q, v, ["topic"], "asked", "effective", ["in_force"], ["in_force"]).select("conv_id", "turn", "asked", "in_force")


_STEP = "CASE WHEN value > 100 THEN 0.08 WHEN value > 40 THEN 0.02 ELSE -0.08 END"


@query("feedback_stream", f"WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, ({_STEP})::DOUBLE AS step FROM events WHERE time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR), w AS (SELECT user_id, n, greatest(0.6, least(1.5, 1 + step)) AS v FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, greatest(0.6, least(1.5, w.v + e.step)) FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1) SELECT user_id, max(n) AS events, round(arg_max(v, n), 6) AS value FROM w GROUP BY user_id")
def feedback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights learnt from the stream of events, as far as the watermark has settled it."""
    from tessera.streaming.feedback import current_weights, learnt_online, start_learning

    schema, root = read(spark, sf_dir, "events").schema, Scratch(spark).root
    # A stream of files takes folders and patterns, not the name of one file.
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.expr(f"cast({_STEP} AS double)").alias("step"))
    start_learning(learnt_online(e, ["user_id"], "step", "ts", ["event_id"]), f"{root}/learnt", f"{root}/progress").awaitTermination()
    return current_weights(spark.read.parquet(f"{root}/learnt"), ["user_id"]).select("user_id", "events", F.round("value", 6).alias("value"))


@query("sketch_summary", "SELECT event_type, count(DISTINCT ts::DATE) AS days, count(value) AS n, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS greatest, true AS median_close, true AS p95_close, true AS users_close FROM events GROUP BY event_type")
def sketch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures merged from sketches by day, and whether their quantiles and distinct counts hold their bounds against all rows: 3 points of rank, 6 per cent of users."""
    e = read(spark, sf_dir, "events").select("event_type", F.col("ts").cast("date").alias("day"), "value", "user_id")
    daily = Scratch(spark).table(S.sketched(e, ["event_type", "day"], "value", "user_id"), "daily")
    days = daily.groupBy("event_type").agg(F.count("*").alias("days"))
    told = S.estimates(S.merged(daily, ["event_type"]), ["event_type"], {"median": 0.5, "p95": 0.95})
    below = lambda c: F.avg((F.col("value") < F.col(c)).cast("double")), lambda c: F.avg((F.col("value") <= F.col(c)).cast("double"))
    truth = e.join(told.select("event_type", "median", "p95"), "event_type").groupBy("event_type").agg(
        *(f(c).alias(f"{c}_{side}") for c in ("median", "p95") for side, f in zip(("under", "upto"), below, strict=True)), F.countDistinct("user_id").alias("users"))
    near = lambda c, p: (F.col(f"{c}_under") <= p + 0.03) & (F.col(f"{c}_upto") >= p - 0.03)
    return told.join(days, "event_type").join(truth, "event_type").select(
        "event_type", "days", "n", F.round("mean", 4).alias("mean"), "least", "greatest", near("median", 0.5).alias("median_close"), near("p95", 0.95).alias("p95_close"), (F.abs(F.col("distinct_members") - F.col("users")) <= 0.06 * F.col("users")).alias("users_close"))
