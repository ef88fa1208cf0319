"""Linking and redaction against plain loops over all pairs of parts, and texts with very many spans."""

import random
import re
import time

import pytest
from tessera.llm import secrets

BASE = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "key": re.compile(r"[A-Za-z0-9+/_-]{24,}+"),
    "id": re.compile(r"""(?:access_?key_?id|client_?id|user_?name|user|account|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}+""", re.I | re.A),
    "endpoint": re.compile(r"(?:https?|wss?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/@%-]++"),
}


def plain(text, scope=secrets.SCOPE):
    """Spans by all pairs of parts."""
    found = []
    for rank, kind in enumerate(secrets.KINDS):
        for m in BASE[kind].finditer(text):
            least = {"assign": 8, "access": 16, "hex": 32, "key": 24}.get(kind, 1)
            value = m[2] if kind == "assign" else m[0]
            mixed = all(re.search(p, value) for p in ("[0-9]", "[a-z]", "[A-Z]"))
            if len(value) >= least and (kind != "key" or mixed):
                found.append((m.start(), rank, m.end()))
    base = [s for s in found if s[1] < 3]
    weak = [w for w in found if w[1] >= 3 and not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    role = lambda s: secrets.ROLES[secrets.KINDS[s[1]]]
    met = lambda w, r: any(p is not w and role(p) == r and abs(p[0] - w[0]) <= scope for p in base + weak)
    need = {"key": ["id"], "id": ["secret"], "endpoint": ["id", "secret"]}
    return sorted(base + [w for w in weak if all(met(w, r) for r in need[secrets.KINDS[w[1]]])])


def texts(seed, n, size):
    rng = random.Random(seed)
    parts = ["password", "secret=", "Token:", 'api_key = "', "=", " ", " and then some words ", "\n", "é", "🙂", "AKIAABCDEFGHIJKLMN", "0123456789abcdef0123456789abcdef", "user=bob", "login: anna", "https://a.b/c", "redis://h:1", "aB3dE5fG7hI9jK1lM3nO5pQ7", "abcdefgh", "x" * 90, "lorem ipsum " * 12]
    return [(k, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, size)))) for k in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_linking_equals_all_pairs(spark, seed):
    rows = texts(seed, 150, 40)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan_secrets(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: plain(t) for k, t in rows}
    assert sum(s[1] >= 3 for v in got.values() for s in v) > 50


def test_redaction_in_blocks(spark):
    rows = texts(7, 80, 60) + [(900, None), (901, "")]
    docs = spark.createDataFrame([(k, t, None if t is None else len(t)) for k, t in rows] * 2, "doc_id long, text string, n_chars long")
    expected = {}
    for k, t in rows:
        out, at = [], 0
        for start, _, end in plain(t or ""):
            if start >= at:
                out += [t[at:start], secrets.REDACTED]
            at = max(at, end)
        expected[k] = t if not at else "".join(out) + t[at:]
    for block in (64, secrets.BLOCK):
        got = secrets.redacted(spark, docs, block=block).collect()
        assert len(got) == 2 * len(rows)
        assert all(r.text == expected[r.doc_id] and r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_time_grows_with_spans_not_their_square(spark):
    took = []
    for n in (20_000, 80_000):
        text = " ".join(f"{k:032x}" for k in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begin = time.time()
        found = secrets.scan_secrets(spark, docs).first()
        assert len(found.base) == n and secrets.redacted(spark, docs).first().text.count("[") == n
        took.append(time.time() - begin)
    assert took[1] < 9 * took[0]
