"""Document fingerprints: one-permutation MinHash, optimally densified, packed to low-order bits.

Each shingle of five words is hashed once; the top bits choose one of BINS bins
and a bin keeps its least hash. An empty bin copies a full one, tried in a fixed
pseudorandom order of its own (optimal densification, Shrivastava 2017), so small
sets fill all bins without new hashes. The lowest 8 bits of each bin are stored.
Two fingerprints agree by chance in 1/256 of the bins, which the likeness takes
off again: (share - 1/256) / (1 - 1/256), within 0 to 1.

Texts of under five words are one shingle; texts without words have the empty
fingerprint, like each other by 1 and any other text by 0.

For the neighbour of each document the table is dealt out once, by ranges of
doc_id, and each range gets a copy of the first row of the next; nothing is
ordered in one task.

Defined cases: null text is empty; null doc_ids come last; rows that repeat a
doc_id are ordered by a hash of their text; one row alone is its own next; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import partitions, sliced, table
from tessera.llm.textblocks import utf8, window_hashes, word_hashes, words

SHINGLE, BINS, BITS, SEED = 5, 256, 8, 0xF19
#: donors[i, t]: the bin that empty bin i tries at attempt t.
_DONORS = np.argsort(np.random.Generator(np.random.PCG64(7)).random((BINS, BINS)), axis=1)
_EMPTY = np.uint64(2**64 - 1)
_FIRST_ID = -(1 << 63)


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, the text of each)."""
    w = words(raw, offsets)
    h, owner = word_hashes(w), w.document()
    hashes = window_hashes(h, length, SEED)
    whole = owner[: len(hashes)] == owner[length - 1 :] if len(hashes) else np.zeros(0, bool)
    short = np.flatnonzero((w.counts > 0) & (w.counts < length))
    extra = [window_hashes(h[w.first[k] : w.first[k + 1]], int(w.counts[k]), SEED + int(w.counts[k])) for k in short]
    return np.concatenate([hashes[whole], *extra]), np.concatenate([owner[: len(hashes)][whole], short])


def minhash(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed bins of each text as a row of bytes, whether it has any shingle)."""
    least = np.full(texts * BINS, _EMPTY)
    np.minimum.at(least, owner * BINS + (hashes >> np.uint64(56)).astype(np.int64), hashes & np.uint64((1 << 56) - 1))
    least = least.reshape(texts, BINS)
    full = least != _EMPTY
    filled = full.any(1)
    row, column = np.nonzero(~full & filled[:, None])
    for attempt in range(BINS):
        if not len(row):
            break
        donor = _DONORS[column, attempt]
        ok = full[row, donor]
        least[row[ok], column[ok]] = least[row[ok], donor[ok]]
        row, column = row[~ok], column[~ok]
    return (least & np.uint64((1 << BITS) - 1)).astype(np.uint8), filled


def likeness(a: np.ndarray, a_filled: np.ndarray, b: np.ndarray, b_filled: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of rows of packed bins, free of the bias of chance agreement."""
    chance = 1 / (1 << BITS)
    share = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(a_filled & b_filled, share, (a_filled == b_filled).astype(float))


def _hex(bins: np.ndarray, filled: np.ndarray) -> list[str]:
    return [row.tobytes().hex() if any_ else "" for row, any_ in zip(bins, filled.tolist(), strict=True)]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results for every row but copies, each with the row after it in its range."""
    held: pa.RecordBatch | None = None
    for batch in sliced(batches):
        joined = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
        if joined.num_rows > 1:
            yield _paired(joined)
        held = joined.slice(joined.num_rows - 1)


def _paired(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, at = utf8(batch.column("text"))
    point = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte where each code point begins
    first = np.searchsorted(point, at)
    point = np.append(point, len(raw))
    chars = np.diff(first)
    n = len(chars) - 1
    third = chars[:n] // 3
    cut = point[first[1:-1] - third]
    upto = point[first[1:-1] + np.minimum(third, chars[1:])]
    data = raw.tobytes()
    edited = [data[a:c] + data[b:u] for a, c, b, u in zip(at[:-2].tolist(), cut.tolist(), at[1:-1].tolist(), upto.tolist(), strict=True)]
    digests = [hashlib.sha256(e).hexdigest() for e in edited]
    both = np.concatenate([raw, np.frombuffer(b"".join(edited), np.uint8)])
    ends = np.concatenate([at, at[-1] + np.cumsum([len(e) for e in edited])])
    bins, filled = minhash(*shingle_hashes(both, ends), 2 * n + 1)
    own, nxt, new = slice(0, n), slice(1, n + 1), slice(n + 1, None)
    out = pa.record_batch(
        [batch.column("id").slice(0, n), pa.array(chars[:n]), pa.array(digests), pa.array(_hex(bins[own], filled[own])), pa.array(_hex(bins[new], filled[new])), pa.array(likeness(bins[own], filled[own], bins[new], filled[new])), pa.array(likeness(bins[own], filled[own], bins[nxt], filled[nxt]))],
        names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
    # A copy is the last row of its range, and what follows it belongs to another range.
    return out.filter(pa.array(~batch.column("copy").to_numpy(zero_copy_only=False)[:n]))


def fingerprinted(spark: SparkSession, docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per row of docs, each with its edited text and its next document by descending doc_id."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = ranges or 4 * partitions(spark)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID)).alias("id"))
    splits = ids.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] or []
    borders = F.array(*(F.lit(s) for s in sorted(set(splits)))) if splits else F.array().cast("array<bigint>")
    ranged = lambda df: df.withColumn("range", F.size(F.filter(borders, lambda s: s < F.col("id"))))
    # At most `ranges` rows: the largest id of each range.
    tops = {r["range"]: r["top"] for r in ranged(ids).groupBy("range").agg(F.max("id").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    heads = spark.createDataFrame([(tops[order[(k + 1) % len(order)]], r) for k, r in enumerate(order)], "id long, range int")
    copies = rows.join(F.broadcast(heads), "id").groupBy("range").agg(F.max_by(F.struct("id", "text"), F.struct(F.xxhash64("text"), "text")).alias("head"))
    dealt = ranged(rows).withColumn("copy", F.lit(False)).unionByName(copies.select("range", "head.id", "head.text", F.lit(True).alias("copy")))
    dealt = dealt.repartition(partitions(spark), "range").withColumn("tag", F.xxhash64("text")).sortWithinPartitions("range", "copy", F.desc("id"), F.desc("tag"), F.desc("text"))
    out = dealt.select("id", "text", "copy").mapInArrow(_neighbours, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(F.expr(f"nullif(id, {_FIRST_ID})").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(spark, table(spark, sf_dir, "documents"))
