"""The prefix trie against a plain model: shared prefixes, copies across many partitions, odd rows."""

import hashlib
import random
import zlib

import pytest
from tessera.llm.trie import op11_prefix_trie, prefix_trie, rebuilt, turn_arrays

SCHEMA = "conv_id long, turn long, role string, text string"


def model(rows, rebuild=True):
    held = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            held.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in held.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
        base = lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)
        turns = {c: turns.get(base(c), [])[: h[c]] + v[h[c] :] for c, v in turns.items()}
    members = {}
    for c, v in turns.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    words = lambda t: len([w for w in "".join(" " if x in " \t\n\x0b\x0c\r" else x for x in t).split(" ") if w])
    leaves, saved, children = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(of) - 1) * (words(node[-1][1]) if node else 0)
    ends = lambda node: hashlib.sha256(",".join(map(str, sorted(c for c in members[node] if len(turns[c]) == len(node)))).encode()).hexdigest()
    return sorted((min(of), len(n), min(members[n[:-1]]) if n else -1, len(of), children[n], leaves[n], saved[n], ends(n)) for n, of in members.items())


def shown(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def made(seed, n, hot=0.3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 4 * n), n):
        if rng.random() < hot:  # copies of one conversation
            turns = [("user", "a b"), ("bot", "c")]
        else:
            turns = [(rng.choice(["user", None]), rng.choice(["x y", "z", "", None, "q  w\te"])) for _ in range(rng.choice([1, 1, 2, 3, 5, 30]))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("seed,parts,rebuild", [(1, 1, True), (2, 3, True), (3, 29, False), (4, 64, True)])
def test_equals_the_model(spark, seed, parts, rebuild):
    rows = made(seed, 120)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        arrays = turn_arrays(spark.createDataFrame(rows, SCHEMA))
        assert shown(prefix_trie(spark, rebuilt(arrays) if rebuild else arrays)) == model(rows, rebuild)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark, tmp_path):
    rows = [(20, 2, "a", "late"), (20, None, "a", "first"), (20, 1, None, None), (20, 1, None, None), (20, 1, "b", "tie"), (None, 0, "a", "nobody's"), (21, 0, "a", "first"), (39, 0, "", "long " * 50_000), (7, 0, "a", "first"), (-3, 5, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'extra' AS key", "1 AS words", "2 AS part", "3 AS node")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert shown(op11_prefix_trie(spark, str(tmp_path))) == model(rows)


def test_empty_table(spark):
    assert prefix_trie(spark, rebuilt(turn_arrays(spark.createDataFrame([], SCHEMA)))).collect() == []
