"""Cosines of a question set with all vectors, in tiles: every pair is scored, few rows leave a tile.

Questions are dealt to strips and vectors to blocks; a strip and a block meet once, as arrays, in one
task. A tile gives all its pairs, or the best of each question by one or more rankings: ranks
over all tiles then need those rows only. Components are added in their order, so
cosines are the doubles that `scoring.cosine` gives; vectors that are null, hold nulls or have another
length than a question's score 0 with it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch

#: Vectors of a block at most, and at least where there are fewer blocks than cores; questions of a strip; pairs that are scored together.
BLOCK, LEAST, STRIP, _PAIRS = 8192, 512, 256, 1 << 16


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up, as Spark's round: places next to a half are decided in decimal."""
    scaled = np.abs(x) * 10.0**digits + 0.5
    out = np.floor(scaled)
    for k in np.flatnonzero(np.abs(scaled - np.rint(scaled)) < 1e-5):
        out[k] = float(Decimal(repr(float(abs(x[k])))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP).scaleb(digits))
    return np.copysign(out, x) / 10.0**digits + 0.0


def best(score: np.ndarray, ids: np.ndarray, most: int, digits: int) -> np.ndarray:
    """Places of the `most` largest rounded scores; ties go to the lesser ids."""
    if len(score) <= most:
        return np.arange(len(score))
    least = np.partition(score, len(score) - most)[len(score) - most] - 1.1 * 10.0**-digits
    at = np.flatnonzero(score >= least)
    return at[np.lexsort((ids[at], -rounded(score[at], digits)))[:most]]


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of the commonest length as rows, others zero; their lengths, 0 where null or with a null component)."""
    lengths = np.nan_to_num(np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    flat = vectors.flatten()
    if flat.null_count:
        ends = np.cumsum(lengths)
        of = np.searchsorted(ends, np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)), "right")
        good = np.ones(len(lengths), bool)
        good[of] = False
        kept, lengths = vectors.filter(pa.array(good & (lengths > 0))), np.where(good, lengths, 0)
    else:
        kept = vectors.filter(pa.array(lengths > 0))
    x = np.zeros((len(lengths), int(lengths.max(initial=0))))
    x[np.arange(x.shape[1]) < lengths[:, None]] = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return x, lengths


def _norms(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k] * x[:, k]
    return np.sqrt(total)


def _cosines(q: np.ndarray, q_norm: np.ndarray, columns: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Cosines of rows of q with columns of components, added in order; those with a zero vector are 0."""
    total, part = np.zeros((len(q), columns.shape[1])), np.empty((len(q), columns.shape[1]))
    for k in range(columns.shape[0]):
        np.multiply(q[:, k, None], columns[k], out=part)
        total += part
    norms = q_norm[:, None] * norm
    with np.errstate(all="ignore"):
        c = np.where(norms > 0, total / norms, np.where(np.isnan(norms), np.nan, 0.0))
    return np.where(np.isnan(c), 1.0, np.clip(c, -1.0, 1.0))  # what is not a number is the greatest in Spark


class Tiles:
    """Pairs of questions (q_id, vector) and vectors (vec_id, vector) with different ids, written to blocks when made.

    rows: the vectors with a number of their own, `row`.
    """

    def __init__(self, vectors: DataFrame, asked: DataFrame, block: int = BLOCK, strip: int = STRIP):
        spark = vectors.sparkSession
        scratch, cores = Scratch(spark, tidy=False), spark.sparkContext.defaultParallelism
        self.rows = scratch.table(vectors.where("vec_id IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "rows")
        n, m = self.rows.count(), asked.count()
        blocks = max(math.ceil(n / block), min(cores, math.ceil(n / LEAST)), 1)
        held = self.rows.groupBy(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("row", "vec_id", "vector")).alias("held"))
        strips = asked.where("q_id IS NOT NULL").groupBy(F.pmod(F.xxhash64("q_id"), F.lit(max(1, math.ceil(m / strip)))).alias("strip")).agg(F.collect_list(F.struct("q_id", "vector")).alias("asked"))
        self.pairs = scratch.table(held, "blocks").repartition(min(blocks, 4 * cores), "block").crossJoin(scratch.table(strips, "strips")).select("asked", "held")

    def _scored(self, give: Callable, schema: str) -> DataFrame:
        """Rows that give(q_id, ids, rows, cosines, whether a pair counts) makes of some questions and a block."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    q, p = (batch.column(c).slice(k, 1).flatten() for c in ("asked", "held"))
                    q_id, ids, rows = (a.field(c).to_numpy(zero_copy_only=False) for a, c in ((q, "q_id"), (p, "vec_id"), (p, "row")))
                    (x, q_len), (y, length) = _matrix(q.field("vector")), _matrix(p.field("vector"))
                    q_norm, norm, width = _norms(x), _norms(y), min(x.shape[1], y.shape[1])
                    columns = np.ascontiguousarray(y.T[:width])
                    step = max(1, _PAIRS // max(1, min(len(ids), 1024)))
                    for at in range(0, len(q_id), step):
                        some = slice(at, at + step)
                        c = np.concatenate([_cosines(x[some, :width], q_norm[some], columns[:, a : a + 1024], norm[a : a + 1024]) for a in range(0, len(ids), 1024)], axis=1)
                        c[(q_len[some, None] != length) | (length == 0)] = 0.0
                        yield from give(q_id[some], ids, rows, c, q_id[some, None] != ids)

        return self.pairs.mapInArrow(run, schema)

    def all(self) -> DataFrame:
        """q_id, vec_id, c of every pair."""

        def give(q_id, ids, rows, c, counts):
            for k in range(len(q_id)):
                ok = counts[k]
                yield pa.record_batch([pa.array(np.full(ok.sum(), q_id[k])), pa.array(ids[ok]), pa.array(c[k][ok])], names=["q_id", "vec_id", "c"])

        return self._scored(give, "q_id long, vec_id long, c double")

    def bounds(self) -> DataFrame:
        """q_id, low, high: the least and the greatest cosine of each question."""

        def give(q_id, ids, rows, c, counts):
            any_ = counts.any(1)
            yield pa.record_batch([pa.array(q_id[any_]), pa.array(np.where(counts, c, np.inf).min(1)[any_]), pa.array(np.where(counts, c, -np.inf).max(1)[any_])], names=["q_id", "low", "high"])

        return self._scored(give, "q_id long, low double, high double").groupBy("q_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def best(self, most: int, digits: int, other: Callable[[int, np.ndarray], np.ndarray] | None = None) -> DataFrame:
        """q_id, vec_id, row, c: of every tile the pairs among the `most` best of a question by rounded cosine, or by other(q_id, ids)."""

        def give(q_id, ids, rows, c, counts):
            of, found = [], []
            for k in range(len(q_id)):
                at = np.flatnonzero(counts[k])
                chosen = [best(c[k][at], ids[at], most, digits)] + ([best(other(q_id[k], ids[at]), ids[at], most, digits)] if other else [])
                at = at[np.unique(np.concatenate(chosen))]
                of.append(np.full(len(at), k))
                found.append(at)
            of, found = np.concatenate(of), np.concatenate(found)
            yield pa.record_batch([pa.array(q_id[of]), pa.array(ids[found]), pa.array(rows[found]), pa.array(c[of, found])], names=["q_id", "vec_id", "row", "c"])

        return self._scored(give, "q_id long, vec_id long, row long, c double")
