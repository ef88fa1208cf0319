"""Scoring functions as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import lexicons as L


def _map(table: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct entries; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine within -1 to 1; 0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, clamp(dot(a, b) / norm, -1.0, 1.0)).otherwise(F.lit(0.0))


def calibrated_relevance(dense: Column, lexical: Column) -> Column:
    return 0.6 * clamp(dense) + 0.4 * F.least(F.lit(1.0), lexical / 8.0)


def minmax(value: Column, low: Column, high: Column) -> Column:
    """Place between the least and the greatest of a group; a flat group is all 1."""
    flat = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return F.when(flat, 1.0).otherwise((value - low) / (high - low))


def reciprocal_rank(rank: Column, k: Column | float = 60, weight: Column | float = 1.0) -> Column:
    """A ranked list's part of the fused score; ranks from 1."""
    return F.when(rank.isNotNull(), weight / (k + rank)).otherwise(F.lit(0.0))


def recency_weight(effective: Column, as_of: Column) -> Column:
    """Halves every 540 days; the future counts as today."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0), F.datediff(as_of, effective)) / 540.0)


def noisy_or(cue: Column, ratio: Column) -> Column:
    return 1 - (1 - cue) * (1 - 0.55 * ratio)


def authority_weight(authority: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(L.AUTHORITY_WEIGHTS), authority), F.lit(L.AUTHORITY_WEIGHTS[L.DEFAULT_AUTHORITY]))


def precedence(domain: Column, default: float = L.DEFAULT_PRECEDENCE) -> Column:
    return F.coalesce(F.try_element_at(_map(L.DOMAIN_PRECEDENCE), domain), F.lit(default))


def topicality(relevance: Column, salience: Column) -> Column:
    return F.round(0.60 * relevance + 0.40 * salience, 4)


def claim_confidence(relevance: Column, salience: Column, authority: Column, recency: Column) -> Column:
    return F.round(clamp(0.36 * relevance + 0.26 * salience + 0.22 * authority + 0.16 * recency), 4)


def conflict_score(authority: Column, rank: Column, recency: Column, relevance: Column) -> Column:
    return 0.34 * authority + 0.26 * rank + 0.22 * recency + 0.18 * relevance


def routing_confidence(selected: Column, top: Column, best_rejected: Column) -> Column:
    """From the top score and its margin over the best domain left out (null: none was)."""
    margin = F.least(F.lit(1.0), 2.5 * (top - best_rejected))
    return F.when(selected == 0, 0.0).when(best_rejected.isNull(), F.least(F.lit(1.0), top)).otherwise(0.65 * top + 0.35 * F.greatest(F.lit(0.0), margin))


def complexity(clauses: Column, question_words: Column, tokens: Column, domains: Column) -> Column:
    one = lambda c: F.least(F.lit(1.0), c)
    return F.round(
        0.30 * one((clauses - 1) / 2) + 0.20 * one(F.greatest(F.lit(0), question_words - 1) / 2)
        + 0.20 * one(F.greatest(F.lit(0), tokens - 6) / 18) + 0.30 * one(F.greatest(F.lit(0), domains - 1) / 2), 3)


def answer_confidence(squares: Column, total: Column, documents: Column, near_ties: Column, degraded: Column) -> Column:
    """From sums of claim confidences and their squares, cited documents, near ties and failures."""
    value = 0.82 * squares / total + 0.18 * F.least(F.lit(1.0), documents / 3) - 0.08 * near_ties - 0.12 * degraded.cast("int")
    return F.when(total > 0, F.round(clamp(value), 4)).otherwise(F.lit(0.0))


def confidence_label(c: Column) -> Column:
    return reduce(lambda out, band: F.when(c >= band[0], band[1]).otherwise(out), reversed(L.CONFIDENCE_BANDS[:-1]), F.lit(L.CONFIDENCE_BANDS[-1][1]))


def percentile_rank(p: Column | float, n: Column) -> Column:
    """Rank (from 1) of the nearest-rank percentile with half-even rounding, within 1 to n."""
    p = F.lit(float(p)) if isinstance(p, int | float) else p
    return F.greatest(F.lit(1), F.least(n, F.bround(p / 100 * n + 0.5).cast("int")))
