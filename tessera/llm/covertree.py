"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Unit vectors with cosine c lie sqrt(2-2c) apart. Equal vectors are collapsed to
one with a weight. The rest is dealt to blocks of about BLOCK vectors around
pivots, each block gets a cover tree (nested levels whose radii halve, with the
true covering radius of every node), and every two blocks whose bounding balls
come near enough are traversed together: a pair of nodes whose centres are
farther apart than the threshold and both radii is dropped with all below it.
Surviving pairs of vectors are decided by their cosine in double precision.

A pair of blocks returns one row per linked vector (a count and a link to the
smallest of its component inside the pair), never the pairs, so groups of near
copies cost rows in proportion to their size. With vectors that lie all about
equally far apart no metric tree can prune much; then the cost is one matrix
product per pair of blocks, quadratic in distinct vectors, and every block goes to
every other once. Vectors are scaled by a power of two of their own, which leaves
every cosine as it is, so that no norm overflows or vanishes.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; so do vectors of different lengths; equal vectors
link with each other; rows that repeat a vec_id are separate vectors that share
their least component; null ids count as larger than any other; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Forest, Scratch, components, table

COSINE, BLOCK, MOST_PIVOTS = 0.95, 8192, 1024
#: Blocks whose balls meet in one tile of the join of balls, and candidates that are looked through together.
TILE, _CANDIDATES = 512, 256
_RADII = [2.0 ** -k for k in range(0, 6)]
#: Allowances for rounding: of radii, and of dot products in single precision.
_SLACK, _SINGLE, _EXPANDED = 1e-6, 1e-5, 1 << 19
#: Dot products of one matrix product, about: they stay in the cache.
_PRODUCT = 1 << 19


class CoverTree:
    """Levels of nodes over unit vectors in tree order; every node covers a run of them.

    A level holds, per node, its centre (the first vector of its run), its
    covering radius and its first child on the next level.
    """

    def __init__(self, x: np.ndarray, levels: list[tuple]):
        self.x, self.levels = x.astype(np.float32), levels

    @staticmethod
    def build(x: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """(order of the vectors, levels)."""
        single = x.astype(np.float32)
        order, borders = np.arange(len(x)), [np.array([0, len(x)])]
        for radius in _RADII:
            least, runs = 1 - radius * radius / 2, []
            sizes = np.diff(borders[-1])
            for a, n in zip(borders[-1][:-1].tolist(), sizes.tolist(), strict=True):
                run = order[a : a + n]
                runs += [run] if n == 1 else CoverTree._covered(single, run, least)
            order = np.concatenate(runs)
            borders.append(np.concatenate(([0], np.cumsum([len(r) for r in runs]))))
        borders.append(np.arange(len(x) + 1))
        levels, x = [], x[order]
        for k, border in enumerate(borders):
            centre = border[:-1]
            apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[np.repeat(centre, np.diff(border))])))
            child = np.searchsorted(borders[k + 1], border).astype(np.int32) if k + 1 < len(borders) else None
            levels.append((centre.astype(np.int32), (np.maximum.reduceat(apart, centre) + _SLACK).astype(np.float32), child))
        return order, levels

    @staticmethod
    def _covered(x: np.ndarray, left: np.ndarray, least: float) -> list[np.ndarray]:
        """Runs of the vectors `left`: a centre, then what no earlier centre covers but it does. Centres lie apart from one another.

        Distances are taken to centres only, those of a few candidates at a time.
        """
        runs = []
        while len(left):
            some = left[:_CANDIDATES]
            near = x[some] @ x[some].T >= least
            free, centres = np.ones(len(some), bool), []
            for k in range(len(some)):
                if free[k]:
                    centres.append(k)
                    free &= ~near[k]
                    free[k] = False
            inside = x[left] @ x[some[centres]].T >= least
            inside[centres, np.arange(len(centres))] = True  # whatever rounding says
            first = np.where(inside.any(1), inside.argmax(1), -1)
            first[centres] = np.arange(len(centres))
            by = np.argsort(first, kind="stable")
            ends = np.searchsorted(first[by], np.arange(-1, len(centres)), "right")
            for k, centre in enumerate(some[centres].tolist()):
                run = left[by[ends[k] : ends[k + 1]]]
                runs.append(np.concatenate(([centre], run[run != centre])))
            left = left[first < 0]
        return runs


def _grades(nodes: np.ndarray, radius: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """Nodes by halves of their covering radius: (largest radius, nodes)."""
    grade = np.searchsorted(_RADII[::-1], radius[nodes])
    return [(float(radius[some].max()), some) for g in np.unique(grade) for some in (nodes[grade == g],)]


def near_pairs(a: CoverTree, b: CoverTree, cosine: float = COSINE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions whose vectors reach the cosine to single precision, or nearly, in pieces of bounded size."""
    reach = math.sqrt(2 - 2 * cosine + _SINGLE) + _SLACK
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, p, q = stack.pop()
        (ca, ra, ka), (cb, rb, kb) = a.levels[level], b.levels[level]
        if len(p) == 1:  # one pair of nodes: its children by one matrix product
            if ka is None:
                pa_, pb_ = p, q
            else:
                ia, ib = np.arange(ka[p[0]], ka[p[0] + 1]), np.arange(kb[q[0]], kb[q[0] + 1])
                level += 1
                (ca, ra, ka), (cb, rb, kb) = a.levels[level], b.levels[level]
                # Nodes of about one radius meet together: one bound holds for all their pairs, however wide a few others are.
                for wide_a, some_a in _grades(ia, ra):
                    for wide_b, some_b in _grades(ib, rb):
                        far = 1 - min(2, reach + wide_a + wide_b) ** 2 / 2 - _SINGLE
                        step, y = max(1, _PRODUCT // len(some_b)), b.x[cb[some_b]].T
                        for at in range(0, len(some_a), step):
                            part = some_a[at : at + step]
                            dot = a.x[ca[part]] @ y
                            near = np.flatnonzero(dot >= far)  # a bound for all first
                            i, j = near // len(some_b), near % len(some_b)
                            ok = dot.ravel()[near] >= 1 - np.minimum(2, reach + ra[part[i]] + rb[some_b[j]]) ** 2 / 2 - _SINGLE
                            if ok.any():
                                stack.append((level, part[i[ok]], some_b[j[ok]]))
                continue
        elif len(p) > _EXPANDED:
            half = len(p) // 2
            stack += [(level, p[:half], q[:half]), (level, p[half:], q[half:])]
            continue
        else:
            pa_, pb_ = p, q
        dot = np.einsum("ij,ij->i", a.x[ca[pa_]], b.x[cb[pb_]])
        if ka is None:
            hit = dot >= cosine - _SINGLE
            yield ca[pa_[hit]], cb[pb_[hit]]
            continue
        keep = dot >= 1 - np.minimum(2, reach + ra[pa_] + rb[pb_]) ** 2 / 2 - _SINGLE
        p, q = pa_[keep], pb_[keep]
        na, nb = ka[p + 1] - ka[p], kb[q + 1] - kb[q]
        # Children pairs, in portions of bounded size.
        each = np.cumsum(na * nb)
        begin = 0
        while begin < len(p):
            end = max(begin + 1, int(np.searchsorted(each, (each[begin - 1] if begin else 0) + _EXPANDED)))
            if end == begin + 1 and na[begin] * nb[begin] > _EXPANDED:
                stack.append((level, p[begin:end], q[begin:end]))
            else:
                n = (na * nb)[begin:end]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                width = np.repeat(nb[begin:end], n)
                stack.append((level + 1, np.repeat(ka[p[begin:end]], n) + nth // width, np.repeat(kb[q[begin:end]], n) + nth % width))
            begin = end


def _exact(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Cosine in double precision of given rows, against the threshold."""
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))) >= cosine


def _linked(pair: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Counts and component links of two blocks (or one with itself)."""
    trees, ids, weights, raw = [], [], [], []
    for r in pair.sort_values("side").itertuples():
        x = np.frombuffer(r.vectors, np.float32 if r.single else np.float64).reshape(len(r.ids) // 8, -1).astype(np.float64)
        trees.append(CoverTree(x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], pickle.loads(r.levels)))
        raw.append(x)
        ids.append(np.frombuffer(r.ids, np.int64))
        weights.append(np.frombuffer(r.weights, np.int64))
    same = len(trees) == 1
    a, b = trees[0], trees[-1]
    shift = 0 if same else len(ids[0])
    count, forest = np.zeros(shift + len(ids[-1]), np.int64), Forest(shift + len(ids[-1]))
    for i, j in near_pairs(a, b, cosine):
        ok = _exact(raw[0][i], raw[-1][j], cosine)
        if same:
            ok &= i < j
        i, j = i[ok], j[ok]
        count += np.bincount(i, weights[-1][j], len(count)).astype(np.int64) + np.bincount(j + shift, weights[0][i], len(count)).astype(np.int64)
        forest.add(i, j + shift)
    every = ids[0] if same else np.concatenate(ids)
    hit = np.flatnonzero(count)
    return pd.DataFrame({"key": every[hit], "links": count[hit], "near": every[forest.root[hit]]})


def _blocks(keyed: DataFrame, spark: SparkSession, scratch: Scratch, block: int) -> DataFrame:
    """(block, centre, radius, ids, weights, vectors) of vectors (key, weight, size, v), packed."""
    total = keyed.count()
    pivots = min(MOST_PIVOTS, math.ceil(total / block))
    # A bounded sample, by hashed key, only chooses the pivots; every vector is dealt to its nearest.
    sample = keyed.orderBy(F.xxhash64("v"), "v").limit(pivots).select("v").collect()
    centres = [np.frombuffer(r.v, np.float64) for r in sample]
    centres = [c / np.linalg.norm(c) for c in centres]

    of_length: dict[int, list[int]] = {}
    for k, c in enumerate(centres):
        of_length.setdefault(len(c), []).append(k)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacked = {n: (np.array(ks, np.int32), np.stack([centres[k] for k in ks])) for n, ks in of_length.items()}
        for batch in batches:
            sizes, raw = batch.column("size").to_numpy(), batch.column("v").to_pylist()
            cells = np.zeros(len(raw), np.int32)
            for n in np.unique(sizes).tolist():
                if n in stacked:  # vectors of a length that no pivot has share a cell, told apart by their length
                    at = np.flatnonzero(sizes == n)
                    x = np.frombuffer(b"".join(raw[k] for k in at.tolist()), np.float64).reshape(-1, n)
                    cells[at] = stacked[n][0][(x @ stacked[n][1].T).argmax(1)]
            yield pa.record_batch([*batch.columns, pa.array(cells, pa.int32())], names=[*batch.schema.names, "cell"])

    celled = scratch.table(keyed.mapInArrow(nearest, "key long, weight long, size int, v binary, cell int"), "celled")
    # A cell of more than a block is cut by hash; so blocks are bounded whatever a cell holds.
    held = celled.groupBy("cell", "size").agg(F.count("*").alias("held")).withColumn("cuts", F.ceil(F.col("held") / block))
    cut = celled.join(F.broadcast(held), ["cell", "size"]).withColumn("part", F.expr("pmod(xxhash64(v), cuts)"))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v, np.float64) for v in group["v"]])
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        centre = unit.mean(0)
        order, levels = CoverTree.build(unit)
        x = x[order]
        single = bool((x.astype(np.float32) == x).all())
        return pd.DataFrame({
            "size": [x.shape[1]], "centre": [centre.tolist()], "radius": [float(np.linalg.norm(unit - centre, axis=1).max()) + _SLACK],
            "ids": [group["key"].to_numpy(np.int64)[order].tobytes()], "weights": [group["weight"].to_numpy(np.int64)[order].tobytes()],
            "single": [single], "vectors": [(x.astype(np.float32) if single else x).tobytes()], "levels": [pickle.dumps(levels)],
        })

    out = cut.groupBy("cell", "size", "part").applyInPandas(packed, "size int, centre array<double>, radius double, ids binary, weights binary, single boolean, vectors binary, levels binary")
    return scratch.table(out.withColumn("block", F.xxhash64("ids")), "blocks")


def embedding_links(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    scratch = Scratch(spark)
    v = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    good = F.coalesce((F.size("v") > 0) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0), F.lit(False))
    rows = rows.select("vec_id", good.alias("good"), F.when(good, F.col("v")).alias("v"))
    # Rows of one vector share a key; -0.0 and 0.0 are told apart, which only costs a comparison.
    rows = scratch.table(rows.select("vec_id", "good", "v", F.struct(F.xxhash64("v"), F.hash("v")).alias("hashed")), "rows")
    classes = rows.where("good").groupBy("hashed", "v").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("weight"))
    # The table is written once, so these numbers stay; unlike a hash they never meet.
    classes = scratch.table(classes.withColumn("key", F.monotonically_increasing_id()), "classes")

    def doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            lengths = lists.value_lengths().to_numpy()
            at = np.concatenate(([0], np.cumsum(lengths)))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if len(lengths):  # a power of two brings each vector's largest component to [0.5, 1)
                _, power = np.frexp(np.maximum.reduceat(np.abs(flat), at[:-1]))
                flat = np.ldexp(flat, -np.repeat(power, lengths))
            yield pa.record_batch([batch.column("key"), batch.column("weight"), lists.value_lengths(), pa.array([flat[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["key", "weight", "size", "v"])

    keyed = scratch.table(classes.select("key", "weight", "v").mapInArrow(doubles, "key long, weight long, size int, v binary"), "keyed")
    blocks = _blocks(keyed, spark, scratch, block)
    reach = math.sqrt(2 - 2 * cosine) + 4 * _SLACK
    balls = blocks.select("block", "size", "centre", "radius")
    # Bounding balls only: one row per block, and only pairs whose balls come within the threshold go on.
    # Blocks are dealt to strips; two strips meet in a tile of at most about TILE * TILE pairs.
    strips = max(1, math.ceil(balls.count() / TILE))
    strip = F.expr(f"pmod(xxhash64(block), {strips})")
    every = F.explode(F.expr(f"sequence(0, {strips - 1})"))
    left = balls.select(strip.alias("row"), every.alias("column"), "size", F.col("block").alias("a"), F.col("centre").alias("centre_a"), F.col("radius").alias("radius_a"))
    right = balls.select(strip.alias("column"), every.alias("row"), "size", F.col("block").alias("b"), F.col("centre").alias("centre_b"), F.col("radius").alias("radius_b"))
    apart = F.sqrt(F.aggregate(F.zip_with("centre_a", "centre_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e))
    pairs = left.join(right, ["row", "column", "size"]).where(F.col("a") <= F.col("b")).where(apart <= F.col("radius_a") + F.col("radius_b") + reach).select("a", "b")
    sides = pairs.select("a", "b", F.explode(F.expr("CASE WHEN a = b THEN array(named_struct('side', 0, 'block', a)) ELSE array(named_struct('side', 0, 'block', a), named_struct('side', 1, 'block', b)) END")).alias("s"))
    work = scratch.table(sides.select("a", "b", "s.side", "s.block"), "work").join(blocks.select("block", "ids", "weights", "single", "vectors", "levels"), "block")
    found = work.groupBy("a", "b").applyInPandas(lambda pair: _linked(pair, cosine), "key long, links long, near long")
    found = scratch.table(found, "found")
    counted = found.groupBy("key").agg(F.sum("links").alias("others"))
    roots = components(found.where("key <> near").select(F.col("key").alias("a"), F.col("near").alias("b")), scratch, "near")
    joined = roots.withColumnRenamed("node", "key").join(classes.select("key", "smallest"), "key")
    least = joined.groupBy("root").agg(F.min("smallest").alias("least"))
    of = scratch.table(roots.withColumnRenamed("node", "key").join(least, "root").select("key", "least"), "of")
    whole = classes.select("hashed", "key", "weight", "smallest").join(counted, "key", "left").join(of, "key", "left")
    whole = scratch.table(whole.select("hashed", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "smallest").alias("component_id")), "whole")
    linked = rows.where("good").select("vec_id", "hashed").join(whole, "hashed").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark, table(spark, sf_dir, "embeddings"))
