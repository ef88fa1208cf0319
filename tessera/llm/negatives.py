"""Hard-negative mining with product quantisation and rigorous residual bounds.

Vectors become integers (floor of SCALE times each component). A product quantiser,
fitted on a bounded sample, cuts a vector into sub-vectors of WIDTH components and
stores the nearest of 256 integer centroids of each, and the norm of what is left.
An anchor's table of products with all centroids then gives its score with every
vector by look-ups: the exact score lies within (norm of the anchor) x (norm of the
residual) of it, by Cauchy-Schwarz, in integers rounded outwards. Only rows whose interval meets what is
asked for are scored exactly, so results are exact whatever the quantiser is like.

Anchors meet all rows in tiles: rows are dealt to strips, anchors to bands, and a task
streams the rows of its tile past its anchors, in batches. Only the best few rows an
anchor go on from a tile, first the positives, then the ten of each window. The grid
keeps the copies of rows and anchors in proportion; work is anchors times rows, which is what
a stated query set against all rows asks for.

Defined cases: rows with a null label, a null vector or any null or non-finite
component take no part; vectors meet those of their own length only; an empty vector
has score 0 with others of its kind; components beyond the bound of `largest` are held
there, so that no score overflows; rows that repeat a vec_id are rows of their own,
also as anchors; a null vec_id comes after all others and is no anchor; anchors
without a positive, and windows without a row, give no rows; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, partitions, table

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A window: low% to high% of the positive's score.
LOW, HIGH = 30, 90
#: Components of a sub-vector, centroids of each, rows of the fitting sample, rounds of fitting, lengths of vectors that get a quantiser.
WIDTH, CENTROIDS, SAMPLE, ROUNDS, LENGTHS = 2, 256, 4096, 6, 8
#: Pairs of a tile at most, about, and at least; most anchors of a band.
_TILE, _SMALL, _BAND = 1 << 31, 1 << 16, 1 << 16
_ROW = "uid long, vec_id long, label int, size int, v binary, codes binary, rest long"
_NONE = np.iinfo(np.int64).min


def largest(size: int) -> int:
    """The bound of components of vectors of this length: 100 times any score fits in 64 bits."""
    return math.isqrt((2**63 - 1) // (100 * max(size, 1)))


def integer_rows(vectors: DataFrame, changed: Column | None = None) -> DataFrame:
    """vec_id, label, size, v (64-bit integers as bytes) of the rows that take part; label is `changed` if given."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.transform("embedding", lambda e: e.cast("double")).alias("e"))
    good = F.col("label").isNotNull() & F.col("e").isNotNull() & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.coalesce(good, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("e")
            sizes = lists.value_lengths().to_numpy()
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE)
            bound = np.repeat(np.array([largest(int(n)) for n in sizes], np.float64), sizes)
            flat = np.clip(flat, -bound, bound).astype(np.int64)
            at = np.concatenate(([0], np.cumsum(sizes)))
            v = pa.array([flat[a:z].tobytes() for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(sizes, pa.int32()), v], names=["vec_id", "label", "size", "v"])

    label = F.col("label") if changed is None else changed
    return rows.withColumn("label", label.cast("int")).mapInArrow(run, "vec_id long, label int, size int, v binary")


def fitted(sample: np.ndarray) -> np.ndarray:
    """Integer centroids (parts, CENTROIDS, WIDTH) of the rows: k-means of each sub-vector. A last, shorter part is filled with zeros."""
    parts = -(-sample.shape[1] // WIDTH)
    padded = np.zeros((len(sample), parts * WIDTH))
    padded[:, : sample.shape[1]] = sample
    out = np.zeros((parts, CENTROIDS, WIDTH), np.int64)
    for m in range(parts):
        x = padded[:, m * WIDTH : (m + 1) * WIDTH]
        # Begin with rows spread evenly over the order by the first principal direction.
        _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False) if len(x) > 1 else (0, 0, np.eye(WIDTH))
        c = x[np.argsort(x @ axes[0], kind="stable")[np.linspace(0, len(x) - 1, CENTROIDS).astype(int)]]
        for _ in range(ROUNDS):
            near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            n = np.bincount(near, minlength=CENTROIDS)
            sums = np.stack([np.bincount(near, x[:, w], CENTROIDS) for w in range(WIDTH)], 1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        out[m] = np.rint(c)
    return out


def encoded(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes by part, norm of the residual rounded up) of integer rows."""
    parts = len(centroids)
    padded = np.zeros((len(x), parts * WIDTH), np.int64)
    padded[:, : x.shape[1]] = x
    codes, square = np.zeros((len(x), parts), np.uint8), np.zeros(len(x))
    for m, c in enumerate(centroids):
        part = padded[:, m * WIDTH : (m + 1) * WIDTH]
        near = ((c * c).sum(1) - 2.0 * (part.astype(float) @ c.T.astype(float))).argmin(1)
        codes[:, m] = near
        square += ((part - c[near]).astype(float) ** 2).sum(1)
    return codes, _norm(square)


def _norm(square: np.ndarray) -> np.ndarray:
    """An integer at least the root of a sum of squares in double precision."""
    return np.ceil(np.sqrt(square) * (1 + 1e-9)).astype(np.int64)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of x with y. Doubles hold them exactly where no partial sum can pass 2**53."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    if float(np.abs(x).max()) * float(np.abs(y).max()) * len(y) < 2.0**53:
        return (x.astype(np.float64) @ y.astype(np.float64)).astype(np.int64)
    return (x * y).sum(1)


class Rows:
    """A batch of rows of one length as arrays."""

    def __init__(self, batch: pa.RecordBatch, at: np.ndarray, size: int, parts: int):
        taken = batch.take(pa.array(at))
        joined = lambda c: b"".join(taken.column(c).to_pylist())
        self.uid, self.label, self.rest = (taken.column(c).to_numpy() for c in ("uid", "label", "rest"))
        self.id = taken.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        self.known = taken.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
        self.x = np.frombuffer(joined("v"), np.int64).reshape(len(at), size)
        self.codes = np.ascontiguousarray(np.frombuffer(joined("codes"), np.uint8).reshape(len(at), parts).T) if parts else np.zeros((0, len(at)), np.uint8)


class Anchor:
    """One anchor: its look-up tables and the best rows so far of each of its questions."""

    def __init__(self, uid: int, id_: int, label: int, x: np.ndarray, centroids: np.ndarray, scores: list[int] | None):
        self.uid, self.id, self.label, self.x = uid, id_, label, x
        padded = np.zeros(len(centroids) * WIDTH, np.int64)
        padded[: len(x)] = x
        tables = np.einsum("mkw,mw->mk", centroids, padded.reshape(-1, WIDTH)) if len(centroids) else np.zeros((0, CENTROIDS), np.int64)
        self.tables = tables.astype(np.int32) if np.abs(tables).max(1, initial=0).sum() < 2**31 else tables
        self.norm = int(_norm(np.array([(x.astype(float) ** 2).sum()]))[0])
        # (lowest, highest score) of each question; the positives are one question without bounds.
        self.asked = [(None, None)] if scores is None else [(-(-LOW * s // 100), HIGH * s // 100) for s in scores]
        self.most = POSITIVES if scores is None else NEGATIVES
        self.best = [(np.zeros(0, np.int64),) * 3 for _ in self.asked]  # score, id, known; best first

    def meet(self, rows: Rows, same: bool) -> None:
        """same: rows of its own label, without itself, are asked for; otherwise those of others."""
        asked = (rows.label == self.label) & (rows.uid != self.uid) if same else rows.label != self.label
        at = np.flatnonzero(asked)
        if not len(at):
            return
        about = np.zeros(len(at), self.tables.dtype)
        for part, codes in zip(self.tables, rows.codes if len(at) == len(rows.label) else rows.codes[:, at], strict=True):
            about += part.take(codes)
        about, apart = about.astype(np.int64), rows.rest[at] * self.norm if self.norm < 2**31 and rows.rest.max() < 2**31 else np.full(len(at), np.iinfo(np.int64).max // 4)
        least, most = about - apart, about + apart
        score = np.full(len(at), _NONE)
        for k, (low, high) in enumerate(self.asked):
            held = self.best[k][0]
            bound = max(_NONE if low is None else low, int(held[-1]) if len(held) == self.most else _NONE)
            near = most >= bound
            if high is not None:
                near &= least <= high
            near = np.flatnonzero(near)
            fresh = near[score[near] == _NONE]
            score[fresh] = _exact(rows.x[at[fresh]], self.x)
            exact = score[near]
            ok = exact >= bound if high is None else (exact >= bound) & (exact <= high)
            near = near[ok]
            if len(near):
                s, i, known = np.concatenate((held, score[near])), np.concatenate((self.best[k][1], rows.id[at[near]])), np.concatenate((self.best[k][2], rows.known[at[near]]))
                order = np.lexsort((i, -s))[: self.most]
                self.best[k] = (s[order], i[order], known[order])

    def found(self) -> list[tuple]:
        """(uid, id, question, row's id, score)."""
        return [(self.uid, self.id, k, int(i) if ok else None, int(s)) for k, best in enumerate(self.best) for s, i, ok in zip(*best, strict=True)]


_FOUND = pa.schema([("uid", pa.int64()), ("anchor_id", pa.int64()), ("question", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _tile(batches: Iterator[pa.RecordBatch], model: dict[int, np.ndarray], same: bool) -> Iterator[pa.RecordBatch]:
    """The best rows of every tile; rows come by (tile, size), anchors before the rows they meet."""
    tile, anchors = None, []

    def out() -> Iterator[pa.RecordBatch]:
        for k in range(0, len(anchors), 4096):
            rows = [r for a in anchors[k : k + 4096] for r in a.found()]
            yield pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, r, strict=True)) for r in rows], schema=_FOUND)

    for batch in batches:
        tiles, sizes, sides = (batch.column(c).to_numpy() for c in ("tile", "size", "side"))
        cuts = np.flatnonzero(np.concatenate(([True], (np.diff(tiles) != 0) | (np.diff(sizes) != 0) | (np.diff(sides) != 0))))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(tiles)], strict=True):
            size = int(sizes[a])
            if tile != (tiles[a], size):
                yield from out()
                tile, anchors = (tiles[a], size), []
            centroids = model.get(size, np.zeros((0, CENTROIDS, WIDTH), np.int64))
            part = batch.slice(a, z - a)
            if sides[a] == 0:
                columns = (part.column(c).to_pylist() for c in ("uid", "vec_id", "label", "v", "scores"))
                anchors += [Anchor(uid, i, label, np.frombuffer(v, np.int64), centroids, None if same else scores) for uid, i, label, v, scores in zip(*columns, strict=True)]
            elif anchors:
                rows = Rows(part, np.arange(part.num_rows), size, len(centroids))
                for anchor in anchors:
                    anchor.meet(rows, same)
    yield from out()


def grid(rows: int, anchors: int, tasks: int) -> tuple[int, int]:
    """(strips of rows, bands of anchors): tiles of bounded work, one a task where there is enough of it; bands cost copies of all rows, strips those of anchors and of what they find."""
    tiles = max(1, min(tasks, -(-rows * anchors // _SMALL)), -(-rows * anchors // _TILE))
    bands = max(1, round(math.sqrt(tiles * anchors / max(rows, 1))), -(-anchors // _BAND))
    return -(-tiles // bands), bands


def _nearest(spark: SparkSession, coded: DataFrame, anchors: DataFrame, model: dict[int, np.ndarray], strips: int, bands: int, same: bool) -> DataFrame:
    """uid, anchor_id, question, id, score: the best rows of every question over all tiles. anchors: with `scores`."""
    own = F.pmod(F.xxhash64("uid"), F.lit(strips)).cast("int")
    band = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(bands)).cast("int")
    left = anchors.select(F.explode(F.expr(f"sequence(0, {strips - 1})")).alias("strip"), band.alias("band"), F.lit(0).alias("side"), *anchors.columns)
    right = coded.select(own.alias("strip"), F.explode(F.expr(f"sequence(0, {bands - 1})")).alias("band"), F.lit(1).alias("side"), "*")
    every = left.unionByName(right, allowMissingColumns=True).withColumn("tile", F.col("strip").cast("long") * bands + F.col("band"))
    dealt = every.repartition(strips * bands, "tile").sortWithinPartitions("tile", "size", "side")
    found = dealt.mapInArrow(lambda it: _tile(it, model, same), "uid long, anchor_id long, question int, id long, score long")
    best = Window.partitionBy("uid", "question").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= (POSITIVES if same else NEGATIVES))


def hard_negatives(spark: SparkSession, rows: DataFrame, anchors: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of integer rows (vec_id, label, size, v)."""
    scratch = Scratch(spark)
    rows = scratch.table(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    lengths = [r["size"] for r in rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(LENGTHS).collect()]
    sample = rows.where(F.col("size").isin(lengths) & (F.col("size") > 0)).orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("size", "v").collect() if lengths else []
    model = {n: fitted(np.stack([np.frombuffer(r.v, np.int64) for r in sample if r["size"] == n]).astype(float)) for n in {r["size"] for r in sample}}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, raw = batch.column("size").to_numpy(), batch.column("v").to_pylist()
            codes, rest = [b""] * len(raw), np.zeros(len(raw), np.int64)
            for n in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == n)
                x = np.frombuffer(b"".join(raw[k] for k in at.tolist()), np.int64).reshape(len(at), n)
                found, rest[at] = encoded(x, model[n]) if n in model else (None, _norm((x.astype(float) ** 2).sum(1)))
                for k, c in zip(at.tolist(), found if found is not None else (), strict=False):
                    codes[k] = c.tobytes()
            yield pa.record_batch([*(batch.column(c) for c in ("uid", "vec_id", "label", "size", "v")), pa.array(codes, pa.binary()), pa.array(rest)], names=["uid", "vec_id", "label", "size", "v", "codes", "rest"])

    coded = scratch.table(rows.select("uid", "vec_id", "label", "size", "v").mapInArrow(code, _ROW), "coded")
    asked = coded.where(anchors).select("uid", "vec_id", "label", "size", "v").withColumn("scores", F.array().cast("array<long>"))
    strips, bands = grid(coded.count(), asked.count(), partitions(spark))
    first = _nearest(spark, coded, asked, model, strips, bands, True).select("uid", "anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    first = scratch.table(first, "positives")
    scores = first.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    second = _nearest(spark, coded, asked.drop("scores").join(scores, "uid"), model, strips, bands, False)
    second = second.select("uid", (F.col("question") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return first.join(second, ["uid", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark, integer_rows(table(spark, sf_dir, "embeddings"), changed), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH e AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid, a.vec_id AS anchor_id, b.uid AS other, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0),
p AS (SELECT uid, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (uid)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WINDOW w AS (PARTITION BY uid, p.other ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
