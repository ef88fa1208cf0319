"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then Hamming distance.

A fingerprint is cut into four 16-bit blocks. Two fingerprints that differ in at
most two bits agree on at least two blocks, so each is filed under its six pairs
of blocks (32 bits) and only fingerprints filed together are compared. Copies
are collapsed to one fingerprint first. A file of up to SMALL_FILE fingerprints
is joined with itself and the distance verified. A larger one never makes its
pairs: each member is listed under itself and its 32 one-bit neighbours in the
free blocks; members listed under one value differ in two bits at most, and any
two that do share a value, so a star to the smallest keeps every component whole
at a linear cost.

Defined cases: null or empty text has fingerprint zero, linked like any other; a
null doc_id is never a component's smallest unless it is alone (then null);
repeated rows keep one output row each; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, components, quoted, sliced, table, whole_row
from tessera.llm.textblocks import gathered, utf8, words

BLOCKS, BLOCK_BITS, DISTANCE = 4, 16, 2
SMALL_FILE = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: byte -> its low and high four bits as four 16-bit counters each
_LANES = [np.array([sum(((b >> (4 * half + k)) & 1) << (16 * k) for k in range(4)) for b in range(256)], np.uint64) for half in (0, 1)]
_MOST = 60_000  # counters hold 16 bits; longer documents are summed in stretches


def simhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprint of each group first[k]:first[k+1] of hashes: a bit set in over half of them."""
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begins = np.concatenate([np.arange(first[k], first[k + 1], _MOST) for k in full]) if counts.max() > _MOST else first[full]
    owner = np.searchsorted(first[full], begins, "right") - 1
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        column = octets[:, byte]
        for half in (0, 1):
            sums = np.add.reduceat(_LANES[half][column], begins)
            for k in range(4):
                ones = np.bincount(owner, ((sums >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(float), len(full)).astype(np.int64)
                out[full] |= (2 * ones > counts[full]).astype(np.uint64) << np.uint64(8 * byte + 4 * half + k)
    return out


def text_fingerprints(column: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints (unsigned) of whole texts."""
    raw, offsets = utf8(column)
    w = words(_LOWER[raw], offsets)
    joined, _ = gathered(w.raw, w.start, w.end, w.first)
    lengths = w.end - w.start
    filled = np.diff(w.first) > 0
    begin = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1] - np.repeat(np.cumsum(filled) - filled, w.counts)
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    shingles = np.maximum(w.counts - shingle + 1, filled)
    first = np.concatenate(([0], np.cumsum(shingles)))
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], shingles)  # its first word
    last = np.minimum(at + shingle - 1, np.repeat(w.first[1:], shingles) - 1)
    ends = (begin + lengths)[last] if len(last) else last
    hashes = np.fromiter((digest(text[a:z], seed) for a, z in zip(begin[at].tolist() if len(at) else [], ends.tolist(), strict=True)), np.uint64, first[-1])
    return simhash(hashes, first)


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, tag, fp) of every row; tag stands for the text, fp is the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fp = text_fingerprints(batch.column("text"), shingle, seed)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "tag": batch.column("tag"), "fp": pa.array(fp.view(np.int64))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, tag long, fp long")


def near_links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`: every component of Hamming distance 2 stays connected."""
    mask = (1 << BLOCK_BITS) - 1
    files = [
        F.struct(F.lit(k).alias("pair"), F.concat_ws("-", *((F.shiftrightunsigned("fp", BLOCK_BITS * b).bitwiseAND(F.lit(mask))).cast("string") for b in kept)).alias("key"))
        for k, kept in enumerate(combinations(range(BLOCKS), BLOCKS - DISTANCE))
    ]
    filed = distinct.select("fp", F.explode(F.array(*files)).alias("file")).select("fp", "file.pair", "file.key")
    shared = filed.groupBy("pair", "key").agg(F.count("*").alias("members")).where("members > 1")
    filed = scratch.table(filed.join(shared, ["pair", "key"]), "filed")
    small = filed.where(F.col("members") <= SMALL_FILE)
    pairs = (
        small.select("pair", "key", F.col("fp").alias("a")).join(small.select("pair", "key", F.col("fp").alias("b")), ["pair", "key"])
        .where(F.col("a") < F.col("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    )
    free = F.array(*(F.array(*(F.lit(BLOCK_BITS * b + bit) for b in range(BLOCKS) if b not in kept for bit in range(BLOCK_BITS))) for kept in combinations(range(BLOCKS), BLOCKS - DISTANCE)))
    listed = filed.where(F.col("members") > SMALL_FILE).select(
        "pair", "fp", F.explode(F.concat(F.array("fp"), F.transform(F.element_at(free, F.col("pair") + 1), lambda bit: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))))).alias("value")
    )
    stars = listed.groupBy("pair", "value").agg(F.min("fp").alias("a"))
    star = listed.join(stars, ["pair", "value"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(star).distinct()


def simhash_components(spark: SparkSession, docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of docs: doc_id, tag, fp (long), component_id (smallest doc_id reachable over links), root (the component)."""
    scratch = Scratch(spark)
    marked = scratch.table(fingerprints(docs, shingle, seed), "marked")
    distinct = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "distinct")
    roots = components(near_links(distinct.select("fp"), scratch), scratch, "near")
    member = roots.withColumnRenamed("node", "fp").join(distinct, "fp")
    smallest = member.groupBy("root").agg(F.min("smallest").alias("component_id"))
    linked = scratch.table(roots.withColumnRenamed("node", "fp").join(smallest, "root").select("fp", "component_id", "root"), "linked")
    owner = scratch.table(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "smallest").alias("component_id"), F.coalesce("root", "fp").alias("root")), "owner")
    return marked.join(owner, "fp").select("doc_id", "tag", "fp", "component_id", "root")


def keep_one(spark: SparkSession, docs: DataFrame, grouped: Callable[[SparkSession, DataFrame], DataFrame] = simhash_components) -> DataFrame:
    """One row of each near-duplicate group, all columns unchanged: that of the smallest doc_id, null ids last.

    `grouped` gives doc_id, tag (of the text) and root (the group) of every row.

    Rows are told apart by id and text, so rows with one id and unrelated texts
    are in groups of their own and each group keeps one. Among texts with the
    kept id the one of the least tag stays; of rows with the same id and text the
    one whose columns hash lowest. So the choice never depends on partitions.
    """
    scratch = Scratch(spark)
    found = grouped(spark, docs).groupBy("root", "doc_id", "tag").agg(F.count("*").alias("rows"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag", "rows")).alias("least")
    kept = scratch.table(found.groupBy("root").agg(least).select("least.doc_id", "least.tag", "least.rows"), "kept")
    tagged = docs.select(whole_row(docs).alias("_row"), quoted("doc_id").cast("long").alias("_id"), F.xxhash64(quoted("text").cast("string")).alias("_tag"))

    def of(chosen: DataFrame) -> DataFrame:
        return tagged.join(chosen, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tag") == F.col("tag")), "left_semi")

    once = of(kept.where("rows = 1")).select("_row")
    again = of(kept.where("rows > 1")).groupBy("_id", "_tag").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row")
    return once.unionByName(again).select(*(quoted(c, "_row").alias(c) for c in docs.columns))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
