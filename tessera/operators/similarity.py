"""Threshold joins of sets by Jaccard likeness, without comparing all pairs.

Words are ordered by how many sets hold them, rarest first. Two sets of likeness t share a word among the first
n - ceil(t * n) + 1 of each, so only those prefixes meet, on the word and a grade of
length: lengths of alike sets differ by a factor of 1/t at most, hence a grade meets itself and
its neighbours, and a frequent word is split by grades. What meets must also leave enough words behind the
place where it met. Surviving pairs are decided on whole sets. Equal sets count as one
class, so copies cost nothing.

Empty sets are like nothing, not even one another; ids that repeat are an error of the caller.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ordered(sets: DataFrame, counts: DataFrame, t: float, side: str) -> DataFrame:
    """id, n, words by rising frequency."""
    words = sets.select(F.col("id"), F.explode("words").alias("word")).join(counts, "word")
    listed = words.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("w"))
    return listed.select(F.col("id").alias(side), F.size("w").alias(f"n_{side}"), F.transform("w", lambda x: x["word"]).alias(f"w_{side}"))


def _prefixes(ordered: DataFrame, t: float, side: str, grades: Column) -> DataFrame:
    n = F.col(f"n_{side}")
    kept = F.slice(f"w_{side}", F.lit(1), n - F.ceil(n * t - 1e-9).cast("int") + 1)
    rows = ordered.select(side, f"n_{side}", F.posexplode(kept).alias(f"at_{side}", "word"))
    return rows.withColumn("grade", grades)


def _within_reach(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """The sets of right with so many words that left has too as likeness t needs: t of their own. The other words are not shuffled."""
    known = left.select(F.explode("words").alias("word")).distinct()
    met = right.select("id", F.size("words").alias("n"), F.explode("words").alias("word")).join(known, "word", "left_semi").groupBy("id", "n").agg(F.count("*").alias("both"))
    return right.join(met.where(F.col("both") >= F.col("n") * t - 1e-9).select("id"), "id", "left_semi")


def similar_pairs(left: DataFrame, right: DataFrame | None = None, threshold: float = 0.72) -> DataFrame:
    """(a, b, jaccard) of sets (id, words) whose likeness reaches the threshold: of left with right, or of left with itself (a < b).

    All pairs are given, also of equal sets; `similar_classes` keeps copies together.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    clean = lambda df: df.select("id", F.array_distinct("words").alias("words")).where("size(words) > 0")
    own = right is None
    left, right = clean(left), clean(left if own else right)
    if not own:
        right = _within_reach(left, right, threshold)
    every = left.select(F.explode("words").alias("word")) if own else left.select(F.explode("words").alias("word")).unionAll(right.select(F.explode("words").alias("word")))
    counts = every.groupBy("word").agg(F.count("*").alias("often"))
    a, b = _ordered(left, counts, threshold, "a"), _ordered(right, counts, threshold, "b")
    width = math.log(1 / threshold) + 1e-9 if threshold < 1 else 1.0
    grade = lambda side: F.floor(F.log(F.col(f"n_{side}")) / width).cast("int")
    near = F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: k + grade("b")))
    met = _prefixes(a, threshold, "a", grade("a")).join(_prefixes(b, threshold, "b", near), ["word", "grade"])
    n_a, n_b = F.col("n_a"), F.col("n_b")
    enough = F.ceil(threshold / (1 + threshold) * (n_a + n_b) - 1e-9)
    met = met.where((n_b >= n_a * threshold - 1e-9) & (n_a >= n_b * threshold - 1e-9) & (F.least(n_a - F.col("at_a"), n_b - F.col("at_b")) >= enough))
    pairs = met.where("a < b") if own else met
    pairs = pairs.select("a", "b").distinct()
    both = pairs.join(a.select("a", "n_a", "w_a"), "a").join(b.select("b", "n_b", "w_b"), "b").withColumn("both", F.size(F.array_intersect("w_a", "w_b")))
    return both.select("a", "b", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("jaccard")).where(F.col("jaccard") >= threshold)


def similar_classes(sets: DataFrame, threshold: float = 0.72) -> tuple[DataFrame, DataFrame]:
    """(members: id, class; pairs: a, b, jaccard) of sets (id, words): equal sets are one class, named by its least id, and pairs are of classes."""
    keyed = sets.select("id", F.array_sort(F.array_distinct("words")).alias("words"))
    classes = keyed.groupBy("words").agg(F.min("id").alias("class"))
    members = keyed.join(classes, "words").select("id", "class")
    return members, similar_pairs(classes.select(F.col("class").alias("id"), "words"), None, threshold)
