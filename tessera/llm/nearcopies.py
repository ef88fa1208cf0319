"""Near copies by words: Jaccard likeness of 0.8 or more over shingles of five words.

Pairs to look at come from two places. SimHash fingerprints of the same shingles
go through the pigeonhole blocks of `simhash` (2 bits of 64 at most). That finds
copies and close copies, but likeness 0.8 is about 10 bits of 64, which no blocks
of 64 bits can tell from chance: by blocks alone 10 bits need thousands of keys a
text. So pairs also come from the MinHash of `fingerprints`: 42 bands of six of its
256 bins. Were bins independent, a pair of likeness 0.8 would share no band once in
300,000 times; short texts fill bins with copies, so theirs is more often (not
measured). Every link of either kind is then verified on the whole shingle sets.

Equal shingle sets are collapsed first. In each band's file the members are
compared with a hub, the smallest, and so linked at a linear cost. What is not
yet in one component with the rest of its file is compared with all of the file's
members outside its own component, so no link between components is left out.
That part is cut into tiles of two parts of at most PART members, whose whole sets
meet in one sparse product; it grows with the square of a file that holds many
components, as texts of likeness just under 0.8 to one another do.

Defined cases: null, empty and wordless texts are one group; texts of under five
words are one shingle; a null doc_id is never a component's smallest unless it is
alone (then null); repeated rows keep one output row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Forest, Scratch, components, partitions, sliced
from tessera.llm.fingerprints import minhash, shingle_hashes
from tessera.llm.simhash import near_links, simhash
from tessera.llm.textblocks import mixed, utf8

LIKENESS, BANDS, ROWS = 0.8, 42, 6
#: Members of a part of a file (a tile holds two parts), and shingles of a tile that one product takes.
PART, _COLUMNS = 256, 1 << 14
_EDGES = "a long, b long"


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, the text of each in order, their number per text)."""
    hashes, owner = shingle_hashes(*utf8(column))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, owner, np.bincount(owner, minlength=len(column))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, node, fp, bands, n) of every row: tag stands for the text, node for its set of n shingles, fp is their SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hashes, owner, n = _sets(batch.column("text"))
            node = np.zeros(batch.num_rows, np.uint64)
            np.add.at(node, owner, mixed(hashes + np.uint64(0x5E7)))
            fp = simhash(hashes, np.concatenate(([0], np.cumsum(n))))
            bins, _ = minhash(hashes, owner, batch.num_rows)
            rows = np.ascontiguousarray(bins[:, : BANDS * ROWS]).reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = (rows << (np.arange(ROWS, dtype=np.uint64) * np.uint64(8))).sum(2, dtype=np.uint64)
            keys |= np.arange(BANDS, dtype=np.uint64) << np.uint64(48)
            bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.view(np.int64).ravel()))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "tag": batch.column("tag"), "node": pa.array(node.view(np.int64)), "fp": pa.array(fp.view(np.int64)), "bands": bands, "n": pa.array(n.astype(np.int64))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, tag long, node long, fp long, bands array<long>, n long")


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of rows (node, text): the whole set as sorted 64-bit hashes."""
    for batch in sliced(batches):
        hashes, _, n = _sets(batch.column("text"))
        ends = np.concatenate(([0], 8 * np.cumsum(n)))
        raw = hashes.tobytes()
        yield pa.record_batch({"node": batch.column("node"), "shingles": pa.array([raw[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())})


def _near(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with `both` in common are alike; in whole numbers, so that exactly 0.8 counts."""
    return 10 * both >= round(10 * LIKENESS) * (n + m - both)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all shingles one set after another, number per set)."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint64), np.array([len(p) // 8 for p in parts], np.int64)


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of rows (a, b, shingles, others) whose sets are alike."""
    for batch in sliced(batches, "shingles"):
        (h, n), (g, m) = _flat(batch.column("shingles")), _flat(batch.column("others"))
        rows = np.arange(batch.num_rows)
        place, value = np.concatenate([np.repeat(rows, n), np.repeat(rows, m)]), np.concatenate([h, g])
        order = np.lexsort((value, place))
        place, value = place[order], value[order]
        same = (place[1:] == place[:-1]) & (value[1:] == value[:-1])
        both = np.bincount(place[1:][same], minlength=batch.num_rows)
        yield pa.record_batch({c: batch.column(c) for c in ("a", "b")}).filter(pa.array(_near(both, n, m)))


def tile_links(node: np.ndarray, root: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (a, b) of the links between members of a tile that have different roots."""
    value, n = _flat(column)
    owner = np.repeat(np.arange(len(n)), n)
    _, place, times = np.unique(value, return_inverse=True, return_counts=True)
    shared = times[place] > 1  # a shingle of one member alone is in no intersection
    column_of = (np.cumsum(times > 1) - 1)[place[shared]]
    owner, width = owner[shared], int((times > 1).sum())
    order = np.argsort(column_of, kind="stable")
    owner, column_of = owner[order], column_of[order]
    both = np.zeros((len(n), len(n)), np.float32)
    for begin in range(0, width, _COLUMNS):
        a, z = np.searchsorted(column_of, (begin, begin + _COLUMNS))
        held = np.zeros((len(n), min(_COLUMNS, width - begin)), np.float32)
        held[owner[a:z], column_of[a:z] - begin] = 1
        both += held @ held.T
    i, j = np.nonzero(np.triu(_near(both.astype(np.int64), n[:, None], n[None, :]), 1))
    apart = root[i] != root[j]
    i, j = i[apart], j[apart]
    forest = Forest(len(n))
    forest.add(i, j)
    linked = np.flatnonzero(forest.root != np.arange(len(n)))
    return node[forest.root[linked]], node[linked]


def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (tile, node, root, shingles) that come tile by tile."""
    held: pa.Table | None = None
    for batch in chain(batches, [None]):
        table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if table is None or not table.num_rows:
            continue
        tile = table.column("tile").to_numpy()
        borders = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1], [True])))
        whole = len(borders) - 1 if batch is None else len(borders) - 2  # the last tile may go on in the next batch
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a, z in zip(borders[:whole].tolist(), borders[1 : whole + 1].tolist(), strict=True):
            part = table.slice(a, z - a)
            found.append(tile_links(part.column("node").to_numpy(), part.column("root").to_numpy(), part.column("shingles").combine_chunks()))
        held = table.slice(int(borders[whole])) if batch is not None else None
        if found:
            yield pa.record_batch({x: pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k, x in enumerate("ab")})


def near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, tag (of the text), node (the shingle set), component_id (smallest doc_id reachable over links), root (the component)."""
    scratch = Scratch(spark)
    drawn = scratch.table(sketches(docs), "sketches")
    marked = drawn.select("doc_id", "tag", "node")
    distinct = scratch.table(drawn.groupBy("node").agg(F.min("doc_id").alias("smallest")), "distinct")
    once = drawn.where("n > 0").groupBy("node").agg(F.first("bands").alias("bands"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    # Of the shingle sets with one fingerprint the least stands for it; fingerprints are linked by pigeonhole blocks.
    printed = scratch.table(once.select("node", "n", "fp"), "printed")
    heads = printed.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("head"))
    one_print = printed.join(heads, "fp").where("node <> head.node").select(F.col("head.node").alias("a"), F.col("node").alias("b"), F.col("head.n").alias("n"), F.col("n").alias("m"))
    left, right = (heads.select(F.col("fp").alias(fp), F.col("head.node").alias(x), F.col("head.n").alias(n)) for fp, x, n in (("fp_a", "a", "n"), ("fp_b", "b", "m")))
    links = near_links(heads.select("fp"), Scratch(spark)).toDF("fp_a", "fp_b").join(left, "fp_a").join(right, "fp_b").select("a", "b", "n", "m")
    by_print = scratch.table(one_print.unionByName(links), "by_print")
    filed = once.select("node", "n", F.explode("bands").alias("band"))
    shared = filed.groupBy("band").agg(F.count("*").alias("members"), F.min(F.struct("node", "n")).alias("hub")).where("members > 1")
    filed = scratch.table(filed.join(shared, "band").select("band", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "filed")

    # Any text of a set will do: the one of the least tag.
    met = filed.select("node").unionByName(by_print.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    owner = drawn.groupBy("node").agg(F.min("tag").alias("tag")).join(met, "node")
    source = docs.select(F.col("text").cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    once = source.join(owner, "tag").groupBy("node").agg(F.first("text").alias("text"))
    sets = scratch.table(once.mapInArrow(shingle_sets, "node long, shingles binary"), "sets")

    by_band = filed.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("hub_n").alias("n"), F.col("n").alias("m"))
    # Pairs whose sizes allow the likeness.
    pairs = by_band.unionByName(by_print.select("a", "b", "n", "m")).where(f"10 * least(n, m) >= {round(10 * LIKENESS)} * greatest(n, m)").select("a", "b").distinct()
    left, right = sets.select(F.col("node").alias("a"), "shingles"), sets.select(F.col("node").alias("b"), F.col("shingles").alias("others"))
    stars = scratch.table(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "shingles", "others").mapInArrow(alike, _EDGES), "stars")
    roots = components(stars, scratch, "star")
    rooted = filed.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    # Files not yet in one component: each component's members against those of the others.
    counted = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).where("low <> high")
    split = rooted.join(counted, "band").withColumn("parts", F.expr(f"(members + {PART - 1}) div {PART}")).withColumn("part", F.expr("pmod(xxhash64(node), parts)"))
    tiles = split.select("band", "node", "root", "part", F.explode(F.expr("sequence(0L, parts - 1)")).alias("other"))
    tiles = scratch.table(tiles.select(F.xxhash64("band", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), "node", "root"), "tiles")
    dealt = tiles.join(sets.hint("merge"), "node").repartition(partitions(spark), "tile").sortWithinPartitions("tile")
    rest = scratch.table(dealt.mapInArrow(tiled, _EDGES), "rest")

    linked = components(stars.unionByName(rest), scratch, "near").withColumnRenamed("node", "of").join(distinct, F.col("of") == F.col("node"))
    smallest = linked.groupBy("root").agg(F.min("smallest").alias("component_id"))
    named = scratch.table(linked.join(smallest, "root").select("node", "component_id", "root"), "linked")
    whole = distinct.join(named, "node", "left").select("node", F.coalesce("component_id", "smallest").alias("component_id"), F.coalesce("root", "node").alias("root"))
    return marked.join(scratch.table(whole, "owner"), "node").select("doc_id", "tag", "node", "component_id", "root")
