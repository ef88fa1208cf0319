"""Point in time: the version of a thing that was in force when each question was asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that a bucket of time covers: 32 days.
WIDTH = 32 * 86400


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def in_force(questions: DataFrame, versions: DataFrame, keys: list[str], on: str, effective: str, tie: list[str], take: list[str], width: int = WIDTH) -> DataFrame:
    """questions' columns and `take` of the last version of their key with effective <= on (nulls: none was in force).

    Of versions of a key from one moment the greatest by `tie` counts. Questions
    are reduced to distinct (key, moment) and versions to one a moment before they
    meet, and they meet in buckets of `width` seconds; what was in force when a
    bucket began comes from a table of one row per key and bucket. So no task
    holds all questions or all versions of a busy key, no pairs are made, and the
    last step, which gives every question its answer, is a plain join on
    (key, moment) that Spark can split.

    A null key or moment of a question finds nothing; versions with a null key or
    moment are never in force.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    names = [f"_k{n}" for n in range(len(keys))]
    keyed = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    bucket = F.expr(f"floor(_at / {width * 1_000_000})").alias("_bucket")
    dated = versions.where(known & F.col(effective).isNotNull()).select(*keyed, _micros(effective).alias("_at"), F.struct(*(F.col(c).alias(f"_t{n}") for n, c in enumerate(take))).alias("_ver"), F.struct(*tie).alias("_tie"))
    one = dated.groupBy(*names, "_at").agg(F.max_by("_ver", "_tie").alias("_ver"))
    asked = questions.where(known & F.col(on).isNotNull()).select(*keyed, _micros(on).alias("_at")).distinct()
    moments = one.select(*names, "_at", F.lit(0).alias("_kind"), "_ver").unionByName(asked.select(*names, "_at", F.lit(1).alias("_kind"), F.lit(None).cast(one.schema["_ver"].dataType).alias("_ver"))).select("*", bucket)
    inside = Window.partitionBy(*names, "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    within = moments.withColumn("_ver", F.last("_ver", ignorenulls=True).over(inside))
    before = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = moments.groupBy(*names, "_bucket").agg(F.max_by("_ver", F.when(F.col("_ver").isNotNull(), F.col("_at"))).alias("_ver"))
    carried = ends.select(*names, "_bucket", F.last("_ver", ignorenulls=True).over(before).alias("_carried"))
    found = within.where("_kind = 1").join(carried, [*names, "_bucket"]).select(*names, "_at", F.coalesce("_ver", "_carried").alias("_ver"))
    own = questions.withColumns({n: F.col(k) for n, k in zip(names, keys, strict=True)} | {"_at": _micros(on)})
    return own.join(found, [*names, "_at"], "left").select(*(own[c] for c in questions.columns), *(F.col(f"_ver._t{n}").alias(c) for n, c in enumerate(take)))
