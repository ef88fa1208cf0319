"""Prefix trie of conversations, from globally sorted turn arrays.

A conversation is one binary key: 16 bytes of SHA-256 for each turn (role and text),
in order. The keys are range-sorted over all partitions, ties by conv_id, so members
of a node of the trie lie next to each other and copies of one conversation may cross
as many partitions as they need: no node and no group of copies is ever gathered. A
partition takes the longest common prefixes (LCPs) of adjacent keys and sweeps them
with a stack of open LCP intervals. An interval that closes gives the nodes of a stretch without branches,
with sums over its rows taken from prefix sums. Nodes on the path of a
partition's first or last key may go on beyond its border: their partial sums are
grouped by a digest of the prefix, and the LCP across each border corrects what both
sides have counted (children and leaves twice, shared tokens not at all).

Memory of a task: about 60 bytes per turn of its partition, which are cut to TURNS
turns on average, and of one conversation 24 bytes a turn, never its text. The
conv_ids that end at a node crossing borders pass in chunks, in order, through one
SHA-256, which cannot be computed otherwise; the chunks hold digits only.

Defined cases: a null role or text is empty; turns of one number (null first) come in
the order of the SHA-256 of role and text; repeated rows are turns of their own; rows
without conv_id belong to no conversation and are left out; an empty table gives no
node; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, partitions, table
from tessera.llm.textblocks import WORD_PATTERN

#: Bytes of a turn in a key; turns of a partition of the sort, on average; most rows that are broadcast.
SIZE, TURNS, BROADCAST_ROWS = 16, 1 << 20, 200_000
_EMPTY = hashlib.sha256(b"").hexdigest()
_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_SWEPT = pa.schema([
    ("kind", pa.int32()), ("part", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
    *((c, pa.int64()) for c in _SUMS), ("ends", pa.string()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("last_words", pa.list_(pa.int64())),
])
_SWEPT_DDL = "kind int, part long, depth long, node binary, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, first_key binary, last_key binary, last_words array<long>"
_NODE, _FRAGMENT, _BORDER = 0, 1, 2


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id, key, words: per conversation the digests and the word counts of its turns, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * SIZE))
    each = turns.select("conv_id", F.struct("turn", digest.alias("digest"), F.regexp_count("text", F.lit(WORD_PATTERN)).cast("long").alias("words")).alias("t"))
    held = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return held.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["digest"])), "")).alias("key"), F.col("t.words").alias("words"))


def rebuilt(arrays: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c with the first h turns of conversation c-c%group in place of its own; h = crc32(c) % most."""
    own = arrays.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    lead = arrays.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.substring("key", 1, SIZE * (most - 1)).alias("lead"), F.slice("words", 1, most - 1).alias("lead_words"))
    both = own.join(lead, "base", "left")
    key = F.concat(F.coalesce(F.expr(f"substring(lead, 1, {SIZE} * h)"), F.lit(b"")), F.expr(f"substring(key, {SIZE} * h + 1)"))
    words = F.concat(F.coalesce(F.expr("slice(lead_words, 1, h)"), F.array().cast("array<long>")), F.expr("slice(words, h + 1, greatest(0, size(words) - h))"))
    return both.select("conv_id", key.alias("key"), words.alias("words"))


class _Run:
    """The sorted conversations of one partition as flat arrays."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches).combine_chunks()
        keys = rows.column("key").combine_chunks().cast(pa.large_binary())
        at = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
        data = keys.buffers()[2]
        self.raw = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]]
        self.at = (at - at[0]) // SIZE  # borders of the conversations, in turns
        self.length = np.diff(self.at)
        self.ids = rows.column("conv_id").to_numpy()
        words = rows.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.words = np.concatenate(([0], np.cumsum(words)))
        self.lcp = self._lcps()

    def _lcps(self) -> np.ndarray:
        """Turns that each key shares with the one before; -1 for the first."""
        digests = self.raw.view(np.uint64).reshape(-1, 2)
        n = np.minimum(self.length[1:], self.length[:-1])
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        other = (digests[self.at[1:-1][row] + place] != digests[self.at[:-2][row] + place]).any(1)
        np.minimum.at(n, row[other], place[other])
        return np.concatenate(([-1], n))

    def key(self, row: int) -> bytes:
        return self.raw[SIZE * self.at[row] : SIZE * self.at[row + 1]].tobytes()

    def tokens(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of the first `depth` turns of each row; a negative depth has none."""
        return self.words[self.at[row] + np.maximum(depth, 0)] - self.words[self.at[row]]


def path_digests(key: bytes, depth: int) -> list[bytes]:
    """Digest of each prefix of a key, from the root to `depth` turns."""
    state = hashlib.sha256()
    out = [state.digest()[:SIZE]]
    for k in range(depth):
        state.update(key[SIZE * k : SIZE * (k + 1)])
        out.append(state.copy().digest()[:SIZE])
    return out


def sweep(length: list[int], lcp: list[int], ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Segments (lo, hi, first, last, least id, children of the top, going on) and the parent segment of each, or -1.

    A segment is the nodes of depths lo+1..hi that hold the rows first..last; a parent's
    top is the node of depth lo. "Going on": still open behind the last row, or begun with the first.
    """
    stack: list[list] = []  # lo, hi, first, least id, children, segments that hang on the top
    out: list[tuple] = []
    parent: list[int] = []

    def close(lo: int, entry: list, last: int, open_: bool) -> int:
        out.append((lo, entry[1], entry[2], last, entry[3], entry[4], open_ or entry[2] == 0))
        parent.append(-1)
        for s in entry[5]:
            parent[s] = len(out) - 1
        return len(out) - 1

    def drop(to: int, last: int, open_: bool) -> None:
        while stack and stack[-1][0] >= to:
            entry = stack.pop()
            s = close(entry[0], entry, last, open_)
            if stack:
                stack[-1][3] = min(stack[-1][3], entry[3])
                stack[-1][5].append(s)

    for i, (n, shared, conv) in enumerate(zip(length, lcp, ids, strict=True)):
        drop(shared, i - 1, False)
        if stack and stack[-1][1] > shared:
            top = stack[-1]
            s = close(shared, top, i - 1, False)
            top[1], top[4], top[5] = shared, 1, [s]
        if n > shared:
            if stack:
                stack[-1][4] += 1
            stack.append([shared, n, i, conv, 0, []])
        else:
            stack[-1][3] = min(stack[-1][3], conv)
    drop(-1, len(length) - 1, True)
    return np.array(out, np.int64).reshape(-1, 7), np.array(parent, np.int64)


def _nodes(run: _Run, part: int) -> Iterator[pa.RecordBatch]:
    """Nodes that lie inside the partition, fragments of those that touch its borders, and the border keys."""
    m, none = len(run.ids), lambda n: pa.nulls(n)
    segments, parent = sweep(run.length.tolist(), run.lcp.tolist(), run.ids.tolist())
    lo, hi, first, last, least, children, going = segments.T
    above = np.where(parent >= 0, parent, 0)
    shared = np.cumsum(np.where(np.arange(m) > 0, run.tokens(np.arange(m), run.lcp), 0))
    leaf = np.concatenate(([0], np.cumsum(np.append(run.length[:-1] > run.lcp[1:], True))))
    new = np.append(np.flatnonzero((run.lcp != run.length) | (np.arange(m) == 0)), m)  # first rows of equal keys
    copies = np.zeros(m, np.int64)
    copies[new[:-1]] = np.diff(new)
    paths = [path_digests(run.key(k), int(run.length[k])) for k in (0, m - 1)]
    digest = lambda row, depth: [paths[0][d] if r == 0 else paths[1][d] for r, d in zip(row.tolist(), depth.tolist(), strict=True)]
    for kind in (_NODE, _FRAGMENT):
        chosen = np.flatnonzero(going == (kind == _FRAGMENT))
        each = np.cumsum((hi - lo)[chosen])
        begin = 0
        while begin < len(chosen):  # portions of about 100,000 nodes
            end = max(begin + 1, int(np.searchsorted(each, (each[begin - 1] if begin else 0) + 100_000)))
            some = chosen[begin:end]
            begin = end
            n = (hi - lo)[some]
            s = np.repeat(some, n)
            depth = lo[s] + 1 + np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
            top, bottom = depth == hi[s], depth == lo[s] + 1
            saved = shared[last[s]] - shared[first[s]] - (last - first)[s] * run.tokens(first[s], depth - 1)
            ended = np.where(top & (hi[s] == run.length[first[s]]), copies[first[s]], 0)
            texts = np.full(len(s), _EMPTY if kind == _NODE else "", object)
            for k in np.flatnonzero(ended).tolist():
                row = int(first[s[k]])
                listed = ",".join(map(str, run.ids[row : row + int(ended[k])].tolist()))
                texts[k] = hashlib.sha256(listed.encode()).hexdigest() if kind == _NODE else listed
            up = above[s]
            if kind == _NODE:
                outside = bottom & (going[up] == 1)
                where = np.flatnonzero(outside)
                above_digest = np.full(len(s), None, object)
                above_digest[where] = digest(first[up[where]], depth[where] - 1)
                node, above_id = none(len(s)), pa.array(np.where(bottom, least[up], least[s]), mask=outside)
            else:
                node, above_id = pa.array(digest(first[s], depth), pa.binary()), none(len(s))
                above_digest = [x if d else None for x, d in zip(digest(first[s], np.maximum(depth - 1, 0)), depth.tolist(), strict=True)]
            columns = [pa.array(np.full(len(s), kind, np.int32)), pa.array(np.full(len(s), part, np.int64)), depth, node, pa.array(list(above_digest), pa.binary()), least[s], above_id,
                       (last - first + 1)[s], np.where(top, children[s], 1), leaf[last[s] + 1] - leaf[first[s]], saved, pa.array(texts.tolist(), pa.string()), none(len(s)), none(len(s)), none(len(s))]
            yield _batch(columns)
    words = np.diff(run.words[run.at[m - 1] : run.at[m] + 1])
    empty = [none(1)] * 9
    yield _batch([pa.array([_BORDER], pa.int32()), [part], *empty, none(1), pa.array([run.key(0)], pa.binary()), pa.array([run.key(m - 1)], pa.binary()), pa.array([words.tolist()], pa.list_(pa.int64()))])


def _batch(columns: list) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns]
    return pa.record_batch([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, _SWEPT, strict=True)], schema=_SWEPT)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        yield from _nodes(_Run(held), TaskContext.get().partitionId())


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the two sides of a border have counted wrongly, per node that crosses it."""
    for batch in batches:
        for left, words, right in zip(*(batch.column(c).to_pylist() for c in ("last_key", "last_words", "next_key")), strict=True):
            n = min(len(left), len(right)) // SIZE
            shared = next((k for k in range(n) if left[SIZE * k : SIZE * (k + 1)] != right[SIZE * k : SIZE * (k + 1)]), n)
            before = np.concatenate(([0], np.cumsum(words or [0])))
            depth = np.arange(shared + 1)
            yield pa.record_batch([
                pa.array(path_digests(left, shared), pa.binary()), pa.array(-(depth < shared).astype(np.int64)),
                pa.array(np.full(shared + 1, -int(shared == len(left) // SIZE), np.int64)), pa.array((before[shared] - before[np.maximum(depth - 1, 0)]).astype(np.int64)),
            ], names=["node", "n_children", "n_leaves", "saved_tokens"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends): SHA-256 of the chunks of each node, which come in order; one chunk is held at a time."""
    node, state = None, None
    out = lambda: pa.record_batch([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends"])
    for batch in batches:
        for of, chunk in zip(batch.column("node").to_pylist(), batch.column("ends"), strict=True):
            if of != node:
                if state is not None:
                    yield out()
                node, state = of, hashlib.sha256()
            else:
                state.update(b",")
            state.update(chunk.as_buffer())
    if state is not None:
        yield out()


def prefix_trie(spark: SparkSession, arrays: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, key, words)."""
    scratch = Scratch(spark)
    arrays = scratch.table(arrays, "arrays")
    turns = arrays.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)), F.count("*")).first()
    dealt = max(partitions(spark), -(-(turns[0] + turns[1]) // TURNS))
    ordered = arrays.repartitionByRange(dealt, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = scratch.table(ordered.mapInArrow(_swept, _SWEPT_DDL), "swept")
    # Borders: one number per partition comes to the driver, to skip empty partitions; keys stay where they are.
    borders = swept.where(F.col("kind") == _BORDER).select("part", "first_key", "last_key", "last_words")
    parts = sorted(r.part for r in borders.select("part").collect())
    following = spark.createDataFrame(list(zip(parts, parts[1:], strict=False)), "part long, following long")
    met = borders.join(F.broadcast(following), "part").join(borders.select(F.col("part").alias("following"), F.col("first_key").alias("next_key")), "following")
    corrections = met.select("last_key", "last_words", "next_key").mapInArrow(_corrections, "node binary, n_children long, n_leaves long, saved_tokens long")
    fragments = swept.where(F.col("kind") == _FRAGMENT)
    sums = fragments.select("node", "depth", "parent", "conv_id", *_SUMS).unionByName(corrections, allowMissingColumns=True).groupBy("node")
    stitched = sums.agg(F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in _SUMS))
    chunks = fragments.where("ends <> ''").select("node", "part", "ends").repartition("node").sortWithinPartitions("node", "part")
    stitched = scratch.table(stitched.join(chunks.mapInArrow(_hashed, "node binary, ends string"), "node", "left").withColumn("ends", F.coalesce("ends", F.lit(_EMPTY))), "stitched")
    known = stitched.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    known = F.broadcast(known) if stitched.count() <= BROADCAST_ROWS else known
    nodes = swept.where(F.col("kind") == _NODE)
    columns = ["conv_id", "depth", "parent_conv_id", *_SUMS, "ends"]
    inside = nodes.where("parent IS NULL").select(*columns)
    hanging = nodes.where("parent IS NOT NULL").select("parent", *columns).unionByName(stitched.select("parent", *columns[:2], *_SUMS, "ends"), allowMissingColumns=True)
    hanging = hanging.join(known, "parent", "left").withColumn("parent_conv_id", F.col("above")).select(*columns)
    return inside.unionByName(hanging).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark, rebuilt(turn_arrays(table(spark, sf_dir, "conversations"))))


def _crc(c: str) -> str:
    step = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({c}::VARCHAR, ''), lambda z: ascii(z)::BIGINT)), lambda a, b: {step}), 4294967295)"


OP11_SQL = f"""
WITH t AS (SELECT conv_id, g, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos FROM (
    SELECT conv_id, turn, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc('conv_id')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, g, words FROM c JOIN t ON t.conv_id = c.base AND pos <= h UNION ALL SELECT c.conv_id, pos, g, words FROM c JOIN t USING (conv_id) WHERE pos > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, words, string_agg(g, '') OVER w AS prefix FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos) UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved FROM p GROUP BY ALL),
e AS (SELECT prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY ALL) USING (conv_id, depth) GROUP BY ALL),
k AS (SELECT left(prefix, len(prefix) - 64) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
s AS (SELECT left(prefix, 64 * a) AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves FROM (SELECT prefix, saved, n_children, unnest(range(depth + 1)) AS a FROM n LEFT JOIN k USING (prefix)) GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN s USING (prefix) LEFT JOIN k USING (prefix) LEFT JOIN e USING (prefix) LEFT JOIN n above ON n.depth > 0 AND above.prefix = left(n.prefix, len(n.prefix) - 64)
"""
