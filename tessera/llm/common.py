"""What the operators share: scratch tables, batch slicing, hashing of ids, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import Scratch, released  # noqa: F401

#: Bytes of text that one numpy pass handles; its arrays take about 40 times this.
SLICE_BYTES = 2 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for k, n in enumerate(lengths.tolist()):
            if held and held + n > limit:
                yield batch.slice(begin, k - begin)
                begin, held = k, 0
            held += n
        yield batch.slice(begin)


def quoted(name: str, of: str = "") -> Column:
    """The column of exactly this name, whatever characters it holds."""
    safe = name.replace("`", "``")
    return F.col(f"{of}.`{safe}`" if of else f"`{safe}`")


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one struct."""
    return F.struct(*map(quoted, docs.columns))


def partitions(spark: SparkSession) -> int:
    """Partitions to deal keyed work into: the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Forest:
    """Union-find over places 0..n-1, batch by batch; a root is the smallest place of its tree."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(flat := self.root[self.root], self.root):
                self.root = flat


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id as text is divisible by 5: such labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), for nodes with an edge.

    Each round hooks every node to its smallest neighbour, halves the parent
    chains until they are flat, and contracts the edges to roots; edges between
    the same roots go. Rounds grow with the logarithm of the longest chain. All
    state is tables; nothing is collected. A node with very many edges is
    only ever grouped with a map-side minimum or joined by a splittable join.
    """
    live = scratch.table(edges.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), f"{name}-edges")
    parents: DataFrame | None = None
    for k in range(most_rounds):
        if live.isEmpty():
            break
        hook = scratch.table(
            live.select(F.col("b").alias("node"), F.col("a").alias("up")).groupBy("node").agg(F.min("up").alias("up")),
            f"{name}-hook{k}",
        )
        # Nodes hook downwards only, so parents form a forest; double the steps until every parent is a root.
        flat = hook
        for j in range(most_rounds):
            above = flat.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            stepped = scratch.table(flat.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")), f"{name}-jump{k}-{j}")
            moved = not stepped.where("moved").isEmpty()
            flat = stepped.select("node", "up")
            if not moved:
                break
        to = lambda c: flat.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023, E731
        live = scratch.table(
            live.join(to("a"), "a", "left").join(to("b"), "b", "left")
            .select(F.coalesce("a_up", "a").alias("x"), F.coalesce("b_up", "b").alias("y")).where("x <> y")
            .selectExpr("least(x, y) AS a", "greatest(x, y) AS b").distinct(),
            f"{name}-live{k}",
        )
        if parents is None:
            parents = flat
        else:
            step = flat.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            moved_on = parents.join(step, "up", "left").select("node", F.coalesce("upper", "up").alias("up"))
            fresh = flat.join(parents.select("node"), "node", "left_anti")
            parents = scratch.table(moved_on.unionByName(fresh), f"{name}-parents{k}")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if parents is None:
        parents = live.select(F.col("a").alias("node"), F.col("b").alias("up"))
    roots = parents.select("up").distinct().join(parents.select(F.col("node").alias("up")), "up", "left_anti")
    return parents.select("node", F.col("up").alias("root")).unionByName(roots.select(F.col("up").alias("node"), F.col("up").alias("root")))
