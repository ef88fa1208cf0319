"""Languages of long texts only, alphabets of any size, and texts longer than a stretch."""

import random

import numpy as np
from tessera.llm import language


def test_a_language_of_long_texts_only_is_learnt(spark):
    rng = random.Random(1)
    de = ["der", "die", "das", "und", "nicht", "ein", "zwischen", "schiff", "strasse"]
    en = ["the", "and", "of", "with", "harbour", "walked", "through", "night"]
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, text(de, 1000), "de") for k in range(30)] + [(k, text(en, 60), "en") for k in range(100, 160)] + [(k, "12 34", "xx") for k in range(200, 230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, language.fit_languages(docs)).collect()}
    assert all(got[i] == (lang if lang != "xx" else "und") for i, _, lang in rows)


def test_letters_count_for_rank(spark):
    """A language whose first documents by hash hold no letter is still learnt; repeated ids are learnt once per text."""
    rows = [(k, "1 2 3", "de") for k in range(200)] + [(500, "schiff und hafen", "de"), (500, "schiff und hafen", "de"), (501, "ship and harbour", "en"), (502, "ship and sea", "en"), (503, "sea und see", "de")]
    parser = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert parser.languages == ["de", "en"]


def test_hashed_transitions_equal_the_dense_table():
    rng = random.Random(2)
    letters = [chr(0x4E00 + k) for k in range(4000)]
    texts = {"zh": ["".join(rng.choice(letters) for _ in range(3000)) for _ in range(3)], "en": ["the cat sat on the mat and the dog ran"], "ru": ["кошка сидит на окне"]}
    dense, hashed = language.CrossParser(texts, 1 << 40), language.CrossParser(texts, 0)
    assert dense.moves.keys is None and hashed.moves.keys is not None
    assert hashed.moves.keys.nbytes + hashed.moves.to.nbytes < dense.moves.to.nbytes / 50
    text = np.array([rng.randrange(0, dense.width) for _ in range(20_000)] + language._squeezed(language.symbols(dense.alphabet)[[ord(c) for c in texts["zh"][0] + texts["en"][0]]]).tolist(), np.uint16)
    at = np.array([0, 0, 5, 2048, 2049, 9000, len(text)])
    assert (dense.phrases(text, at) == hashed.phrases(text, at)).all()


def test_a_stretch_ends_phrases():
    """Beyond BLOCK symbols a new phrase begins: one text of two stretches counts what its stretches count alone."""
    parser = language.CrossParser({"a": ["abcabcabd xyz"], "b": ["qrs abc"]})
    table_of, rng = language.symbols(parser.alphabet), random.Random(3)
    x = language._squeezed(table_of[[ord(rng.choice("abcdxyzqrs ")) for _ in range(5000)]])
    cut = [0, language.BLOCK, 2 * language.BLOCK, len(x)]
    apart = sum(parser.phrases(x[a:z], np.array([0, z - a])) for a, z in zip(cut[:-1], cut[1:], strict=True))
    assert (parser.phrases(x, np.array([0, len(x)])) == apart).all()


def test_total_of_the_sample_is_bounded(spark):
    rows = [(1000 * k + j, f"wort{chr(97 + k)} " * 40, f"l{k:02d}") for k in range(20) for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = language.fit_languages(docs, fit_total=2000)
    assert len(parser.languages) == 20 and parser.cost.max() <= np.log2(102)
