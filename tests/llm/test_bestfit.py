"""Best-fit packing: ids by the library, exact cover, offsets without gaps, few sequences, odd rows."""

import random
import zlib

import numpy as np
import pytest
from tessera.llm import bestfit as B

from tests.conftest import DATA

SCHEMA = "doc_id long, text string"


def library(texts, path=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path or B.vocabulary())
    return [(x.ids if text else []) + [0] for text, x in zip(texts, t.encode_batch([x or "" for x in texts], add_special_tokens=False), strict=True)]


def checked(rows, pieces, capacity):
    """Every id lies in exactly one piece, only long documents are cut, sequences have no gaps; returns the number of sequences."""
    want = sorted((str(i), x) for (i, _), x in zip(rows, library([t for _, t in rows]), strict=True))
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    expected = []
    for i, ids in want:
        first = len(ids) - (len(ids) - 1) // capacity * capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        expected += [(i, k, a, z - a, crc(ids[a:z])) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((str(p.doc_id), p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == sorted(expected)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("parts,unit", [(1, 1 << 18), (40, 1 << 18), (3, 7)])
def test_whole_table(spark, parts, unit):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    pieces = B.pack_best_fit(spark, docs.repartition(parts), unit=unit).collect()
    n = checked(rows, pieces, 2048)
    assert n <= 1.12 * -(-sum(p.length for p in pieces) // 2048) + 1


def test_odd_rows(spark, tmp_path):
    texts = [None, "", " ", "  a", "a  b", "a\n\nb", "\n", "a\tb \t c", "a \n b ", "don't <|endoftext|> stop<|endoftext|>", "é ü ß x", "a\x1cb !\x1c! c", "日本語 テキスト", "x" * 5000, "word " * 6000, "🙂🙂 🙂", "I'LL we'll 'sx", "a", "a", "ends\n", "a\r\nb"]
    rows = [(None if k % 7 == 3 else k // 2, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS bin", "2 AS fill", "3 AS unit", "4 AS piece").write.parquet(f"{tmp_path}/documents.parquet")
    checked(rows, B.op13_best_fit(spark, str(tmp_path)).collect(), 2048)
    assert B.pack_best_fit(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_random_texts_equal_the_library():
    rng = random.Random(3)
    letters = "ab'sré日 \n\t.,1² \x1ć"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)]
    tokens = B.ByteTokens(B.vocabulary())
    assert tokens.fast is not None
    for text, ids in zip(texts, library(texts), strict=True):
        assert np.frombuffer(tokens.encode(text), tokens.kind).tolist() == ids[:-1], repr(text)


def test_other_vocabularies_go_through_the_library():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = B.ByteTokens(path)
    assert not tokens.byte_level
    assert np.frombuffer(tokens.encode("Some Words, here"), tokens.kind).tolist() == library(["Some Words, here"], path)[0][:-1]


def test_best_fit_leaves_no_two_bins_that_fit_together():
    rng = random.Random(5)
    for capacity in (10, 100):
        sizes = sorted((rng.randint(1, capacity) for _ in range(400)), reverse=True)
        bins, offsets = B.best_fit(sizes, capacity)
        fill = np.bincount(bins, sizes)
        assert fill.max() <= capacity and sorted(fill)[0] + sorted(fill)[1] > capacity
        plain, free = [], []  # a plain loop: the fullest bin that holds the item
        for s in sizes:
            fits = [k for k, f in enumerate(free) if f >= s]
            k = min(fits, key=lambda k: free[k]) if fits else len(free)
            free += [capacity] if k == len(free) else []
            free[k] -= s
            plain.append(k)
        assert len(free) == len(fill) and sorted(free) == sorted((capacity - fill).astype(int))


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_tree_merges_to_the_end(spark, fan):
    """Many alike bins and one small one a unit: what one task could join is joined, and moves compose over rounds."""
    from tessera.llm.common import Scratch

    rng = random.Random(fan)
    rows = [(u << 32 | k, 70, u) for u in range(11) for k in range(30)] + [(u << 32 | 99, rng.randint(5, 30), u) for u in range(11)]
    moves = B.merged(spark, spark.createDataFrame(rows, "bin long, fill long, unit long"), Scratch(spark), 100, fan, 0).collect()
    fill = {b: f for b, f, _ in rows}
    moved = {m.bin for m in moves}
    spans = {}
    for m in moves:
        assert m.into not in moved and len(moved) == len(moves)
        spans.setdefault(m.into, [(0, fill[m.into])]).append((m.shift, fill[m.bin]))
    for held in spans.values():
        held.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and sum(held[-1]) <= 100
    assert len(moves) == 11  # every small bin found a place
