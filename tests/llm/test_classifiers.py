"""Scores against plain loops over n-grams, and samples that never depend on partitions."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tessera.llm import ngrams, quality, toxicity

MASK = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def features(text):
    """Counts of hashed n-grams, and the padded length, by a loop over the text."""
    spaces = " \t\n\x0b\x0c\r"
    plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in spaces:
        plain = plain.replace(c, " ")
    padded = f" {' '.join(w for w in plain.split(' ') if w)} "
    found = Counter()
    for n in ngrams.SIZES:
        for k in range(len(padded) - n + 1):
            value = 0
            for c in padded[k : k + n]:
                value = (value * 0x9E3779B97F4A7C15 + mixed(ord(c) + 1)) & MASK
            found[((value ^ (value >> 29)) * 0xBF58476D1CE4E5B9 & MASK) >> (64 - ngrams.BITS)] += 1
    return found, len(padded)


def test_margins_equal_a_loop():
    rng = random.Random(1)
    weights = np.zeros(1 << ngrams.BITS, np.float32)
    weights[np.random.default_rng(2).integers(0, len(weights), 200_000)] = 1.5
    model = ngrams.NgramModel(weights, -0.25)
    texts = ["".join(rng.choice("abcXYZ  \n\té漢🙂.!") for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["", None, "   ", "ab"]
    got = model.margins(pa.array(texts, pa.large_string()))
    for t, margin in zip(texts, got, strict=True):
        found, length = features(t)
        expected = -0.25 + sum(float(weights[f]) * math.log1p(n * 1000 / (length + 300)) for f, n in found.items())
        assert margin == pytest.approx(expected, rel=1e-9, abs=1e-9)


def test_log_count_ratios_scale_the_features():
    """An n-gram of one class only gets a weight of that class's sign; one shared alike gets next to none."""
    texts = [f"grim spite {k} common" for k in range(40)] + [f"kind words {k} common" for k in range(40)]
    model = ngrams.fit_ngrams(texts, np.array([1] * 40 + [0] * 40))
    score = model.margins(pa.array(["grim spite", "kind words", "common"], pa.large_string()))
    assert score[0] > 1 and score[1] < -1 and abs(score[2] - model.intercept) < abs(score[0] - model.intercept) / 3


def rows():
    texts = [(k, f"text of row {k % 30} and more", "en" if k % 2 else "de", f"s{k % 4}") for k in range(200)] + [(500, "x" * 50, "en", "s0"), (501, None, None, None)]
    labels = [(k, int(k % 3 == 0), int(k % 7 == 0)) for k in range(0, 200, 2)] + [(500, 1, 1), (501, 0, 0), (0, 0, 1)]
    return texts, labels


def test_samples_do_not_depend_on_partitions(spark):
    texts, labels = rows()
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    meta = [F.col("lang"), F.col("source")]
    found = [toxicity.fit_sample(docs.repartition(n), known.repartition(n), "toxic", meta, rows=10) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 10
    assert len({r.text for r in found[0]}) == 10
    # Texts too long are left out before the limit, not after it.
    assert len(toxicity.fit_sample(docs, known, "toxic", [], rows=10_000, chars=49)) == len({t for k, t, *_ in texts if t and len(t) <= 49 and any(k == i for i, *_ in labels) and not toxicity_held_out(k)})
    said = {}
    for k, t, *_ in texts:
        for i, _, toxic in labels:
            if i == k and t and not toxicity_held_out(k):
                said[t] = max(said.get(t, 0), toxic)
    assert {r.text: r.label for r in toxicity.fit_sample(docs, known, "toxic", [])} == said


def toxicity_held_out(k):
    import zlib

    return zlib.crc32(str(k).encode()) % 5 == 0


def test_views_exchange_labels_over_the_whole_corpus(spark):
    """What one view is sure of, anywhere in the unlabelled rows, teaches the other; held-out rows are never taken."""
    rng = random.Random(4)
    good, bad = ["measured", "argument", "evidence", "careful"], ["click", "buy", "win", "free"]
    make = lambda k, words, source: (k, " ".join(rng.choice(words) for _ in range(30)) + f" {k}", "en", source)
    texts = [make(k, good if k % 2 else bad, "s1" if k % 2 else "s0") for k in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    seen = []
    plain = quality.co_train

    def spy(labelled, search=None, rounds=quality.ROUNDS):
        def watched(*a):
            seen.append(search(*a))
            return seen[-1]

        return plain(labelled, watched, rounds)

    quality.co_train = spy
    try:
        model = quality.fit_quality(docs, labels, per_round=20)
    finally:
        quality.co_train = plain
    assert len(seen) == quality.ROUNDS
    for by_text, by_page in seen:
        for picked in (by_text, by_page):
            ids = [int(r.text.split()[-1]) for r in picked]
            assert len(ids) >= 10 and min(ids) >= 60 and not any(toxicity_held_out(k) for k in ids)
            assert all(r.label == k % 2 for r, k in zip(picked, ids, strict=True))
    assert not {r.text for r in seen[0][0]} & {r.text for r in seen[1][0]}
    found = quality.score_quality(docs, model).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in found) >= 395
