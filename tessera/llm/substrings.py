"""Substring dedup with difference-cover anchors.

Positions of a document whose index modulo PERIOD lies in COVER are anchors. COVER
is a perfect difference set: for any two positions i and j there is a shift below
PERIOD that takes both onto anchors. A window of `length` words that occurs twice
therefore shares an anchor whose length-PERIOD+1 words are equal, at the same
place of the window. So only about a fifth of the positions is hashed and dealt
out; anchors that two different texts share are kept, and every window around
such an anchor is extended to its full length by a hash of the whole window.

Equal texts count as one content. Rows of a very common passage meet a map-side
minimum or a join whose skewed partitions Spark splits; no group is gathered.

Defined cases: null text has no words; a text under `length` words loses nothing;
rows that repeat a doc_id are not "smaller" than each other, and each keeps its
own row; null doc_ids count as larger than any other and not as smaller than each
other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, sliced, table
from tessera.llm.textblocks import Words, gathered, strings, utf8, window_hashes, word_hashes, words

LENGTH = 50
#: A perfect difference set modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_ANCHOR, _WINDOW, _CONTENT = 0x5EED1, 0x5EED2, 0x5EED3
_LAST = (1 << 63) - 1  # stands for a null doc_id


def _digests(w: Words) -> list[str]:
    joined, at = gathered(w.raw, w.start, w.end, w.first)
    text = joined.tobytes()
    return [hashlib.sha256(text[a:z]).hexdigest() for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _inside(first: np.ndarray, length: int, windows: int) -> np.ndarray:
    """Which of the windows over all words lie in one document."""
    ok = np.ones(max(windows, 0), bool)
    for_each = first[1:-1]
    spoil = np.zeros(windows + 1, np.int64)
    np.add.at(spoil, np.clip(for_each - length + 1, 0, windows), 1)
    np.add.at(spoil, np.clip(for_each, 0, windows), -1)
    return ok & (np.cumsum(spoil)[:windows] == 0)


def _texts(docs: DataFrame) -> DataFrame:
    """(id, tag, text): the tag tells rows apart that repeat a doc_id with another text."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def anchored(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: id, tag, n_words, content (a text's words as 64 bits), whole_sha256, anchors.

    anchors[k] is the hash at anchor k of the text, from the first to the last
    that fits; null where the same content came before in this slice.
    """
    span = length - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    schema = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("content", pa.int64()), ("whole_sha256", pa.string()), ("anchors", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            w = words(*utf8(batch.column("text")))
            h = word_hashes(w)
            at = np.arange(len(h)) - np.repeat(w.first[:-1], w.counts)
            digests = _digests(w)
            content = np.array([int(d[:16], 16) for d in digests], np.uint64).view(np.int64)
            _, newest = np.unique(content, return_index=True)
            fresh = np.zeros(len(content), bool)
            fresh[newest] = True
            fresh &= w.counts >= length
            hashes = window_hashes(h, span, _ANCHOR)
            chosen = cover[at[: len(hashes)] % PERIOD] & _inside(w.first, span, len(hashes)) & np.repeat(fresh, w.counts)[: len(hashes)]
            owner = np.repeat(np.arange(len(content)), w.counts)[: len(hashes)][chosen]
            offsets = np.searchsorted(owner, np.arange(len(content) + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes[chosen].view(np.int64)), mask=pa.array(~fresh))
            yield pa.record_batch([batch.column("id"), batch.column("tag"), pa.array(w.counts), pa.array(content), pa.array(digests), lists], schema=schema)

    return _texts(docs).mapInArrow(run, "id long, tag long, n_words long, content long, whole_sha256 string, anchors array<long>")


def anchor_positions(k: np.ndarray) -> np.ndarray:
    """Word positions of a text's anchors number k."""
    return k // len(COVER) * PERIOD + np.array(sorted(COVER))[k % len(COVER)]


def _extended(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(id, tag, at, window hash) of every window around a shared anchor."""
    for batch in sliced(batches):
        w = words(*utf8(batch.column("text")))
        hashes = window_hashes(word_hashes(w), length, _WINDOW)
        near = np.zeros(len(hashes) + 1, np.int64)
        lists = batch.column("anchors")
        sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
        base = np.repeat(w.first[:-1], sizes)
        anchor = base + anchor_positions(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        np.add.at(near, np.clip(np.maximum(anchor - PERIOD + 1, base), 0, len(hashes)), 1)
        np.add.at(near, np.clip(anchor + 1, 0, len(hashes)), -1)
        chosen = np.flatnonzero((np.cumsum(near)[:-1] > 0) & _inside(w.first, length, len(hashes)))
        owner = np.searchsorted(w.first, chosen, "right") - 1
        ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tag"))
        for k in range(0, len(chosen), 1 << 18):
            part = slice(k, k + (1 << 18))
            yield pa.record_batch([pa.array(ids[owner[part]]), pa.array(tags[owner[part]]), pa.array((chosen[part] - w.first[owner[part]]).astype(np.int32)), pa.array(hashes[chosen[part]].view(np.int64))], names=["id", "tag", "at", "window"])


def _removed(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """(id, n_words, n_removed, kept_sha256 and the kept text if asked for) after removing the windows that begin at `starts`."""
    for batch in sliced(batches):
        w = words(*utf8(batch.column("text")))
        cover = np.zeros(len(w.start) + 1, np.int64)
        lists = batch.column("starts")
        sizes = np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)
        begin = np.repeat(w.first[:-1], sizes) + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + length, -1)
        kept = np.cumsum(cover)[:-1] == 0
        kept |= np.repeat(~batch.column("any").to_numpy(zero_copy_only=False), w.counts)
        first = np.concatenate(([0], np.cumsum(kept)))[w.first]
        left = Words(w.raw, w.start[kept], w.end[kept], first)
        columns = [batch.column("id"), pa.array(w.counts), pa.array(w.counts - left.counts), pa.array(_digests(left))]
        names = ["id", "n_words", "n_removed", "kept_sha256"]
        if texts:
            columns.append(strings(*gathered(left.raw, left.start, left.end, left.first)))
            names.append("kept_text")
        yield pa.record_batch(columns, names=names)


def repeated_windows(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(rows: id, tag, n_words, content, whole_sha256, smallest; starts: content, starts).

    `starts` are the windows of a content that also begin in a document with a smaller id
    than the content's smallest; documents of a content with a larger id than that lose all their words if they
    have `length`.
    """
    scratch = Scratch(spark)
    base = scratch.table(anchored(docs, length), "anchored")
    dealt = base.where("anchors IS NOT NULL").select("content", F.posexplode("anchors").alias("k", "anchor"))
    met = dealt.groupBy("anchor").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low <> high").select("anchor")
    met = scratch.table(met, "met")
    found = scratch.table(dealt.join(met, "anchor").select("content", "k"), "found")
    smallest = scratch.table(base.groupBy("content").agg(F.min(F.struct("id", "tag")).alias("smallest")), "smallest")
    rows = scratch.table(base.select("id", "tag", "n_words", "content", "whole_sha256").join(smallest.select("content", F.col("smallest.id").alias("smallest")), "content"), "rows")
    around = found.groupBy("content").agg(F.collect_set("k").alias("anchors")).join(smallest, "content").select("smallest.id", "smallest.tag", "anchors")
    around = scratch.table(around, "around")
    scratch.drop("anchored")
    windows = _texts(docs).join(around, ["id", "tag"]).mapInArrow(lambda it: _extended(it, length), "id long, tag long, at int, window long")
    windows = scratch.table(windows, "windows")
    first = windows.groupBy("window").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("window", "low")
    first = scratch.table(first, "first")
    repeated = windows.join(first, "window").where("id > low").select("id", "tag", "at")
    of = smallest.select("content", "smallest.id", "smallest.tag")
    starts = scratch.table(repeated.groupBy("id", "tag").agg(F.collect_set("at").alias("starts")).join(of, ["id", "tag"]).select("content", "starts"), "starts")
    scratch.drop("windows")
    return rows, starts


def dedup_substrings(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256."""
    rows, starts = repeated_windows(spark, docs, length)
    copies = rows.where((F.col("id") > F.col("smallest")) & (F.col("n_words") >= length))
    gone = copies.select("id", "n_words", F.col("n_words").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    rest = rows.where((F.col("id") == F.col("smallest")) | (F.col("n_words") < length))
    untouched = rest.join(starts, "content", "left_anti").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole_sha256").alias("kept_sha256"))
    # Rows of one id and content may differ in white space: each is cut in its own text.
    same = rest.select("id", "tag", "content").distinct().join(starts, "content").select("id", "tag", "starts")
    cut = _texts(docs).join(same, ["id", "tag"]).withColumn("any", F.lit(True)).mapInArrow(lambda it: _removed(it, length, False), "id long, n_words long, n_removed long, kept_sha256 string")
    return gone.unionByName(untouched).unionByName(cut).select(F.expr(f"nullif(id, {_LAST})").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark, table(spark, sf_dir, "documents"))
