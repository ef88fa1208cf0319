"""Mixing sources to target weights, in DataFrame and SQL functions only.

The words of a source, documents one after another in hashed order, are packed
into blocks of BLOCK words. The output is a row of slots of one block each, cut
into shards of SHARD slots. Every slot draws its source by a hash of its own with
the sources' target shares as chances, so the source counts of a shard are a
multinomial draw, independent of the other shards'. The counts settle everything
that follows: a source's slots are numbered in shard order by running sums of its
counts, and slot number j of a source takes block perm(j mod blocks) of pass
j div blocks, another permutation for each source and pass; blocks are joined by
index. Draws of a source beyond its target (about the root of their number) go,
in order, to the sources that drew short of theirs, so totals are the targets to
within a block. Permutations are the swap-or-not shuffle (Hoang, Morris and
Rogaway, 2012), which needs no table and no cycle walking, keyed by MD5, so
reruns agree on any cluster.

The mixed documents lie in slot order: a run of neighbouring blocks stays whole,
at the slot of its first. op7_mixing tells, with the totals per document, the
first shard that holds some of it.

Places in a source come from a prefix sum in two steps, by bucket of the hashed
id and then within it, so a source of any size is spread over many tasks.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share
all words; a source's target stops at MOST times its size and the rest is
shared again by weight. That fixed point is min(MOST*size, level*weight) with
one level for all, the largest of (T - caps below) / (weights above) when
sources are ranked by cap per weight.

Defined cases: null and empty texts have size 0 and are taken 0 times; null
sources are one source; rows that repeat are documents each; no words at all
give targets 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, partitions, quoted, table, whole_row
from tessera.llm.textblocks import WORD_PATTERN

BLOCK, SHARD, ROUNDS, MOST = 128, 1024, 20, 3
WEIGHTS = (5, 2, 1)
#: Rows of a bucket, about.
BUCKET_ROWS = 2_000
#: Slots that one task draws, about, most tasks for them, and shards whose counts are summed together first.
TASK_SLOTS, MOST_TASKS, SHARD_GROUP = 16_384, 20_000, 4096
#: Cells that a range of numbers is cut into for interval joins, and most rows of a broadcast table of sources.
CELLS, BROADCAST_ROWS = 1024, 100_000


def _hash(text: str) -> str:
    """A 60-bit number from MD5, as SQL."""
    return f"cast(conv(substring(md5({text}), 1, 15), 16, 10) AS bigint)"


def _permuted(x: str, n: str, rounds: str, label: str) -> Column:
    """Place of x under the swap-or-not permutation of 0..n-1 with these rounds (r, key)."""
    other = f"pmod(k.key - x, {n})"
    return F.expr(f"aggregate({rounds}, {x}, (x, k) -> CASE WHEN md5(concat({label}, '/', k.r, '/', greatest(x, {other}))) < '8' THEN {other} ELSE x END)")


def _rounds(label: str, n: str) -> str:
    return f"transform(sequence(1, {ROUNDS}), r -> named_struct('r', r, 'key', {_hash(f"concat({label}, '/', r)")} % {n}))"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, source, size) of every row; the tag tells repeated ids with other texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"))


def source_plan(totals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per source: rank, size, target, blocks, draws and the first of its draws among all.

    Takes and gives one row per source; the ranking is one small task.
    """
    everything = Window.partitionBy()
    named = totals.select("source", "source_size", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double")
    named = named.select("*", weight.alias("weight"), (F.lit(MOST) * F.col("source_size")).alias("cap"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    below = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    levelled = named.select("*", ((F.sum("source_size").over(everything) - below) / above).alias("reach")).withColumn("level", F.max("reach").over(everything))
    aimed = levelled.select("source", "rank", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"), F.expr(f"(source_size + {block - 1}) div {block}").alias("blocks"))
    drawn = aimed.withColumn("draws", F.expr(f"coalesce(least({MOST} * blocks, cast(floor(target * blocks / nullif(source_size, 0) + 0.5) AS bigint)), 0L)"))
    return drawn.withColumn("first_draw", F.sum("draws").over(Window.orderBy("rank")) - F.col("draws")).withColumn("all_draws", F.sum("draws").over(everything))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few rows, else to be joined by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def _located(points: DataFrame, at: str, intervals: DataFrame, total: int, rows: int) -> DataFrame:
    """points, each with the interval (first, length, ...) that holds its column `at` of 0..total-1; joined by cell of the range."""
    width = max(1, math.ceil(total / CELLS))
    cells = intervals.where("length > 0").select("*", F.explode(F.expr(f"sequence(first div {width}, (first + length - 1) div {width})")).alias("cell"))
    held = F.expr(f"{at} >= first AND {at} < first + length")
    return points.withColumn("cell", F.expr(f"{at} div {width}")).join(_small(cells, rows + CELLS), "cell").where(held).drop("cell")


def shard_counts(plan: DataFrame, scratch: Scratch, seed: str = "mix") -> DataFrame:
    """The multinomial draw: per shard and rank of a source, the slots that drew it, in order."""
    total, sources = plan.agg(F.coalesce(F.sum("draws"), F.lit(0)), F.count("*")).first()
    shards = math.ceil(total / SHARD)
    tasks = min(MOST_TASKS, math.ceil(total / TASK_SLOTS)) or 1
    numbered = plan.sparkSession.range(0, shards, 1, tasks).select(F.col("id").alias("shard"), F.explode(F.expr(f"sequence(id * {SHARD}, least((id + 1) * {SHARD}, {total}L) - 1)")).alias("slot"))
    chance = numbered.select("shard", "slot", F.expr(f"{_hash(f"concat('{seed}/slot/', slot)")} % {max(1, total)}L").alias("chance"))
    chosen = _located(chance, "chance", plan.select("rank", F.col("first_draw").alias("first"), F.col("draws").alias("length")), total, sources)
    return scratch.table(chosen.groupBy("shard", "rank").agg(F.array_sort(F.collect_list("slot")).alias("slots")), "shards")


def slot_draws(plan: DataFrame, seed: str = "mix") -> DataFrame:
    """One row per slot: slot, shard, rank and ordinal (the draw of its source), ordinals 0..draws-1 of each source once."""
    scratch = Scratch(plan.sparkSession)
    drawn = shard_counts(plan, scratch, seed)
    counts = drawn.select("rank", "shard", F.size("slots").cast("long").alias("n"), F.expr(f"shard div {SHARD_GROUP}").alias("group"))
    # Running sums in two steps, so a source is not one task.
    groups = counts.groupBy("rank", "group").agg(F.sum("n").alias("held"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = scratch.table(groups.select("rank", "group", "held", F.coalesce(F.sum("held").over(before("rank", "group")), F.lit(0)).alias("base")), "groups")
    within = counts.select("rank", "group", "shard", F.coalesce(F.sum("n").over(before("rank", "group", "shard")), F.lit(0)).alias("within"))
    firsts = scratch.table(within.join(groups.select("rank", "group", "base"), ["rank", "group"]).select("rank", "shard", (F.col("base") + F.col("within")).alias("first")), "firsts")
    held = groups.groupBy("rank").agg(F.sum("held").alias("drawn"))
    ranked = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    against = plan.select("rank", "draws").join(held, "rank", "left").select("rank", "draws", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    against = against.select("*", F.expr("greatest(0L, drawn - draws)").alias("surplus"), F.expr("greatest(0L, draws - drawn)").alias("length"))
    balance = scratch.table(against.select("*", F.coalesce(F.sum("surplus").over(ranked), F.lit(0)).alias("first_surplus"), F.coalesce(F.sum("length").over(ranked), F.lit(0)).alias("first")), "balance")
    moved, sources, total = balance.agg(F.coalesce(F.sum("surplus"), F.lit(0)), F.count("*"), F.coalesce(F.sum("draws"), F.lit(0))).first()
    tasks = min(MOST_TASKS, math.ceil(total / TASK_SLOTS)) or 1
    # An explicit number of partitions: a few bytes here stand for much work later.
    listed = drawn.repartition(tasks, "shard", "rank").join(firsts.repartition(tasks, "shard", "rank"), ["shard", "rank"])
    numbered = listed.select("shard", "rank", "first", F.posexplode("slots").alias("nth", "slot")).select("shard", "rank", "slot", (F.col("first") + F.col("nth")).alias("ordinal"))
    settled = numbered.join(_small(balance.select("rank", "draws", "first_surplus"), sources), "rank")
    own = settled.where("ordinal < draws").select("slot", "shard", "rank", "ordinal")
    spare = settled.where("ordinal >= draws").select("slot", "shard", (F.col("first_surplus") + F.col("ordinal") - F.col("draws")).alias("number"))
    filled = _located(spare, "number", balance.select("rank", "drawn", "first", "length"), moved, sources)
    return own.unionByName(filled.select("slot", "shard", "rank", (F.col("drawn") + F.col("number") - F.col("first")).alias("ordinal")))


def block_draws(plan: DataFrame, seed: str = "mix") -> DataFrame:
    """One row per slot of the output: slot, shard, rank of the source, pass and block."""
    label = f"concat('{seed}/', rank, '/', pass)"
    passes = plan.where("draws > 0").select("rank", "blocks", F.explode(F.expr("sequence(0L, (draws - 1) div blocks)")).alias("pass"))
    keyed = passes.select("rank", "pass", "blocks", F.expr(label).alias("label"), F.expr(_rounds(label, "blocks")).alias("rounds"))
    draws = slot_draws(plan, seed).join(_small(plan.select("rank", F.col("blocks").alias("of")), n := plan.count()), "rank")
    draws = draws.select("slot", "shard", "rank", F.expr("ordinal div of").alias("pass"), F.expr("ordinal % of").alias("draw")).join(_small(keyed, MOST * n), ["rank", "pass"])
    return draws.select("slot", "shard", "rank", "pass", _permuted("draw", "blocks", "rounds", "label").alias("block"))


def placed(spark: SparkSession, docs: DataFrame, scratch: Scratch, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, tag, size, rank, source_size, target, begin in the source; plan by source)."""
    rows = scratch.table(sized(docs), "sized")
    buckets = max(1, math.ceil(rows.count() / BUCKET_ROWS))
    rows = rows.select("*", F.expr(f"pmod({_hash("concat('doc/', coalesce(cast(doc_id AS string), 'null'))")}, {buckets})").alias("bucket"))
    held = scratch.table(rows.groupBy("source", "bucket").agg(F.sum("size").alias("held")), "held")
    plan = scratch.table(source_plan(held.groupBy("source").agg(F.sum("held").alias("source_size")), block), "plan")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    based = held.select("source", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    based = scratch.table(based.join(plan, based["source"].eqNullSafe(plan["source"])).select(based["source"].alias("of"), F.col("bucket").alias("in_bucket"), "base", "rank", "source_size", "target"), "based")
    order = Window.partitionBy("source", "bucket").orderBy(F.expr(_hash("concat('order/', coalesce(cast(doc_id AS string), 'null'))")), "doc_id", "tag", "size").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("*", (F.sum("size").over(order) - F.col("size")).alias("within"))
    out = within.join(based, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in_bucket")))
    return scratch.table(out.select("doc_id", "tag", "size", "rank", "source_size", "target", (F.col("base") + F.col("within")).alias("begin")), "placed"), plan


def block_shares(rows: DataFrame, plan: DataFrame, block: int = BLOCK, seed: str = "mix", slots: bool = False) -> DataFrame:
    """Each document's share of each block it lies in: rows' columns, block, from and words in the document, times drawn (1 to MOST), first_shard.

    With slots, also places: (pass, slot) of each draw.
    """
    draws = block_draws(plan, seed)
    places = [F.array_sort(F.collect_list(F.struct("pass", "slot"))).alias("places")] if slots else []
    drawn = draws.groupBy("rank", "block").agg(F.count("*").alias("times"), F.min("shard").alias("first_shard"), *places)
    shares = rows.where("size > 0").select("*", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")).alias("block"))
    shares = shares.select("*", F.expr(f"greatest(block * {block} - begin, 0L)").alias("from"), F.expr(f"least((block + 1) * {block} - begin, size)").alias("to"))
    # Draws unfold from a few plan rows, so their estimated size is far too small; they must not be broadcast.
    return shares.join(drawn.hint("merge"), ["rank", "block"]).select("*", (F.col("to") - F.col("from")).alias("words"))


def mix(spark: SparkSession, docs: DataFrame, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, first_shard (the first output shard with some of it; null for none)."""
    scratch = Scratch(spark)
    rows, plan = placed(spark, docs, scratch, block)
    taken = block_shares(rows, plan, block, seed).groupBy("rank", "begin").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("first_shard").alias("first_shard"))
    out = ["doc_id", "size", "source_size", "target"]
    words = rows.where("size > 0").join(taken.hint("merge"), ["rank", "begin"], "left").select(*out, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")
    none = rows.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    return words.unionByName(none)


def sharded_documents(spark: SparkSession, docs: DataFrame, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """The mix as documents: shard, slot, and for each pass the runs of a document's words that it takes, with the columns of docs.

    A run that is the whole document keeps its text as it is; another has its
    words joined by single spaces. n_chars, where present, is the run's length.
    A run stays whole: its place is the slot its first block drew. The columns
    of docs are under `row`.
    """
    scratch = Scratch(spark)
    rows, plan = placed(spark, docs, scratch, block)
    nth = Window.partitionBy("id", "tag").orderBy("begin")
    numbered = rows.select("*", F.coalesce("doc_id", F.lit(-1)).alias("id")).select("*", F.row_number().over(nth).alias("nth"))
    shares = block_shares(numbered, plan, block, seed, slots=True)
    runs = shares.select("id", "tag", "nth", "size", "from", "to", F.explode("places").alias("place"))
    by_pass = runs.groupBy("id", "tag", "nth", "size", "place.pass").agg(F.array_sort(F.collect_list(F.struct("from", "to", "place.slot"))).alias("parts"))
    # Neighbouring parts of a pass join into one run.
    joined = by_pass.select("id", "tag", "nth", "size", "pass", F.explode(F.expr(
        "aggregate(parts, cast(array() AS array<struct<from:bigint,to:bigint,slot:bigint>>), (done, p) -> "
        "CASE WHEN size(done) > 0 AND element_at(done, -1).to = p.from "
        "THEN concat(slice(done, 1, size(done) - 1), array(named_struct('from', element_at(done, -1).from, 'to', p.to, 'slot', element_at(done, -1).slot))) "
        "ELSE concat(done, array(named_struct('from', p.from, 'to', p.to, 'slot', p.slot))) END)"
    )).alias("run")).groupBy("id", "tag", "nth", "size").agg(F.collect_list("run").alias("_runs"))
    joined = scratch.table(joined, "runs")
    # The row travels as one struct, so columns of any name keep their values.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    original = Window.partitionBy("_id", "_tag").orderBy(F.lit(0))
    tagged = docs.select(whole_row(docs).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), F.xxhash64(text).alias("_tag"), text.alias("_text"))
    many = scratch.table(tagged.groupBy("_id", "_tag").agg(F.count("*").alias("rows")).where("rows > 1").select("_id", "_tag"), "many")
    once = tagged.join(many, ["_id", "_tag"], "left_anti").withColumn("_nth", F.lit(1))
    again = tagged.join(many, ["_id", "_tag"], "left_semi").withColumn("_nth", F.row_number().over(original))
    found = once.unionByName(again).join(joined, (F.col("_id") == F.col("id")) & (F.col("_tag") == F.col("tag")) & (F.col("_nth") == F.col("nth")))
    found = found.withColumn("_words", F.when(F.exists("_runs", lambda r: r["to"] - r["from"] < F.col("size")), F.regexp_extract_all("_text", F.lit(f"({WORD_PATTERN})"))))
    each = found.withColumn("_run", F.explode("_runs"))
    part = F.when(F.col("_run.to") - F.col("_run.from") == F.col("size"), F.col("_text")).otherwise(F.expr("array_join(slice(_words, cast(_run.from AS int) + 1, cast(_run.to - _run.from AS int)), ' ')"))
    each = each.select("_row", part.alias("_text"), F.col("_run.slot").alias("slot"))
    columns = {"text": F.col("_text").alias("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    row = F.struct(*(columns.get(c, quoted(c, "_row").alias(c)) for c in docs.columns))
    return each.select(F.expr(f"slot div {SHARD}").alias("shard"), "slot", row.alias("row"))


def mixed_documents(spark: SparkSession, docs: DataFrame, block: int = BLOCK, seed: str = "mix") -> DataFrame:
    """The mix with the columns of docs, dealt out by shard, each shard's rows in the order of their slots."""
    placed_rows = sharded_documents(spark, docs, block, seed)
    dealt = placed_rows.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "slot")
    return dealt.select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents"))


_H = "('0x' || substr(md5({}), 1, 15))::BIGINT"
OP7_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), named AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM totals
), weighed AS (
  SELECT *, CAST([5, 2, 1][(rank % 3 + 1)::INT] AS DOUBLE) AS weight, {MOST} * source_size AS cap FROM named
), reached AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach FROM weighed
), aimed AS (
  SELECT source, rank, source_size, least(cap::DOUBLE, max(reach) OVER () * weight) AS target, (source_size + {BLOCK - 1}) // {BLOCK} AS blocks FROM reached
), counted AS (
  SELECT *, coalesce(least({MOST} * blocks, floor(target * blocks / nullif(source_size, 0) + 0.5)::BIGINT), 0)::BIGINT AS draws FROM aimed
), plan AS (
  SELECT *, (sum(draws) OVER (ORDER BY rank) - draws)::BIGINT AS first_draw, (sum(draws) OVER ())::BIGINT AS all_draws FROM counted
), slots AS (
  SELECT slot, slot // {SHARD} AS shard, {_H.format("concat('mix/slot/', slot)")} % all_draws AS chance FROM (SELECT all_draws, unnest(range(all_draws)) AS slot FROM (SELECT DISTINCT all_draws FROM plan))
), chosen AS (
  SELECT slot, shard, rank, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS ordinal FROM slots JOIN plan ON chance >= first_draw AND chance < first_draw + draws
), against AS (
  SELECT rank, draws, blocks, coalesce(n, 0) AS drawn, greatest(0, coalesce(n, 0) - draws) AS surplus, greatest(0, draws - coalesce(n, 0)) AS short
  FROM plan LEFT JOIN (SELECT rank, count(*) AS n FROM chosen GROUP BY rank) USING (rank)
), balance AS (
  SELECT *, sum(surplus) OVER (ORDER BY rank) - surplus AS first_surplus, sum(short) OVER (ORDER BY rank) - short AS first_short FROM against
), spare AS (
  SELECT slot, shard, first_surplus + ordinal - draws AS number FROM chosen JOIN balance USING (rank) WHERE ordinal >= draws
), settled AS (
  SELECT slot, shard, rank, ordinal::BIGINT AS ordinal FROM chosen JOIN balance USING (rank) WHERE ordinal < draws
  UNION ALL SELECT slot, shard, rank, (drawn + number - first_short)::BIGINT FROM spare JOIN balance ON number >= first_short AND number < first_short + short
), walk AS (
  SELECT rank, shard, blocks, ordinal // blocks AS pass, ordinal % blocks AS x, 0 AS r FROM settled JOIN plan USING (rank)
  UNION ALL
  SELECT rank, shard, blocks, pass, CASE WHEN md5(concat('mix/', rank, '/', pass, '/', r, '/', greatest(x, other))) < '8' THEN other ELSE x END, r
  FROM (SELECT rank, shard, blocks, pass, x, r + 1 AS r,
    (({_H.format("concat('mix/', rank, '/', pass, '/', r + 1)")} % blocks - x) % blocks + blocks) % blocks AS other FROM walk WHERE r < {ROUNDS})
), drawn AS (
  SELECT rank, x AS block, count(*) AS times, min(shard) AS first_shard FROM walk WHERE r = {ROUNDS} GROUP BY rank, x
), buckets AS (
  SELECT greatest(1, ceil(count(*) / {BUCKET_ROWS}))::BIGINT AS buckets FROM sized
), placed AS (
  SELECT s.doc_id, s.size, p.rank, p.source_size, p.target, sum(s.size) OVER (PARTITION BY p.rank ORDER BY
    {_H.format("concat('doc/', coalesce(s.doc_id::VARCHAR, 'null'))")} % (SELECT buckets FROM buckets), {_H.format("concat('order/', coalesce(s.doc_id::VARCHAR, 'null'))")}, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS begin
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), shares AS (
  SELECT *, unnest(range((begin // {BLOCK})::BIGINT, ((begin + size - 1) // {BLOCK} + 1)::BIGINT)) AS block FROM placed WHERE size > 0
), taken AS (
  SELECT s.rank, s.begin, sum((least((s.block + 1) * {BLOCK} - s.begin, s.size) - greatest(s.block * {BLOCK} - s.begin, 0)) * d.times) AS taken, min(first_shard) AS first_shard
  FROM shares s JOIN drawn d ON s.rank = d.rank AND s.block = d.block GROUP BY s.rank, s.begin
)
SELECT p.doc_id, p.size, p.source_size, p.target, CASE WHEN p.size > 0 THEN coalesce(t.taken, 0) ELSE 0 END::BIGINT AS taken, CASE WHEN p.size > 0 THEN t.first_shard END::BIGINT AS first_shard
FROM placed p LEFT JOIN taken t ON p.rank = t.rank AND p.begin = t.begin
"""
