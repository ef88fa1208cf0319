"""Packing to given targets, many sources, and vocabularies of other kinds."""

from collections import Counter

import numpy as np
import pytest
from tessera.llm import packing

TOTALS, WEIGHTS = [9000, 3000, 777, 50, 0], [1, 2, 1, 0, 3]


def stream(layout):
    """(queue, place) of every token of the stream."""
    out = {}
    for q, total in enumerate(layout.totals):
        for a in range(0, total, 37):
            for start, n, sequence, offset in layout.pieces(q, a, min(37, total - a)):
                at = sequence * layout.capacity + offset if sequence < layout.whole // layout.capacity else layout.tail[sequence - layout.whole // layout.capacity][0] + offset
                for k in range(n):
                    assert at + k not in out
                    out[at + k] = (q, a + start + k)
    return [out[k] for k in range(layout.all)]


def test_windows_hold_the_targets_while_sources_last():
    layout = packing.Layout(TOTALS, 100, 4, WEIGHTS)
    found = stream(layout)
    assert sorted(found) == [(q, k) for q, t in enumerate(TOTALS) for k in range(t)]
    for q in range(len(TOTALS)):  # every queue keeps its order within a window's visit
        places = [k for s, k in found if s == q]
        assert places == sorted(places)
    first = layout.phases[0]
    for w in range(sum(first.sends) // layout.width):
        held = Counter(q for q, _ in found[w * layout.width : (w + 1) * layout.width])
        assert all(abs(held[q] - layout.width * first.weights[q] / first.all) <= len(TOTALS) for q in range(len(TOTALS)))
    assert len(layout.phases) == 4 and {q for q, _ in found[-50:]} == {3}


def rows(spark, sources):
    return spark.createDataFrame([(k, f"text {k} of source {k % sources}", f"s{k % sources:03d}" if k % sources else None) for k in range(400)], "doc_id long, text string, source string")


@pytest.mark.parametrize("targets", [None, {"s001": 0.7, None: 0.3}])
def test_many_sources_share_the_last_queue(spark, monkeypatch, targets):
    monkeypatch.setattr(packing, "MOST_QUEUES", 5)
    found = packing.pack(spark, rows(spark, 40), capacity=64, window=2, targets=targets).collect()
    held = Counter()
    for r in found:
        held[r.sequence_id] += r.length
    docs = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        assert r.start == docs.get(r.doc_id, 0)
        docs[r.doc_id] = r.start + r.length
    assert len(docs) == 400 and all(docs[r.doc_id] == r.doc_tokens for r in found)
    assert all(n == 64 or n & (n - 1) == 0 for n in held.values()) and sorted(held) == list(range(len(held)))
    if targets:
        early = {r.doc_id for r in found if r.sequence_id < 2}
        assert {i % 40 for i in early} == {0, 1}


def test_other_vocabularies_go_through_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, ours = Tokenizer.from_file(path), packing.WordTokens(path)
    for t in ("Ab ab  AB\n\tx", "Straße NAÏVE", " lead and trail ", ""):
        assert np.frombuffer(ours.encode([t], b"")[0], ours.kind).tolist() == tokenizer.encode(t, add_special_tokens=False).ids
