"""Edges of the hashes that other tests do not reach: very many shingles, very long words, pairs at the threshold of likeness."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tessera.llm import nearcopies, simhash
from tessera.llm.fingerprints import minhash
from tessera.llm.textblocks import utf8, word_hashes, words


def test_more_shingles_than_a_counter_holds():
    rng = np.random.default_rng(0)
    w = [f"w{k}" for k in rng.integers(0, 5000, 130_001)]
    assert len(w) - 2 > 2 * simhash._MOST
    texts = [" ".join(w), "a b", " ".join(w[:60_002]), ""]

    def plain(t):
        t = t.split()
        shingles = [" ".join(t[k : k + 3]) for k in range(max(1, len(t) - 2))] if t else []
        if not shingles:
            return 0
        bits = np.unpackbits(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(shingles)).tobytes(), "big")

    assert simhash.text_fingerprints(pa.array(texts)).tolist() == [plain(t) for t in texts]


def test_words_of_many_thousand_bytes():
    long = "x" * 4500
    texts = [long, "y " + long + " z", long[:-1] + "y", "x" * 4501, "y" + long[1:], "x" * 4096 + "y" + "x" * 403, "y" + "x" * 4499]
    w = words(*utf8(pa.array(texts)))
    h = word_hashes(w)
    own = [h[w.first[k]] if k != 1 else h[w.first[k] + 1] for k in range(len(texts))]
    assert own[0] == own[1] and own[4] == own[6] and len({int(x) for x in own}) == len(texts) - 2


@pytest.mark.parametrize("n,changed", [(13, 1), (22, 2), (49, 5)])
def test_pairs_at_the_threshold_share_a_band(n, changed):
    """Texts whose last words differ, so that exactly four fifths of their shingles are common."""
    rng = np.random.default_rng(n)
    left, right = [], []
    for k in range(2000):
        w = [f"v{x}" for x in rng.integers(0, 100_000, n)]
        left.append(" ".join(w))
        right.append(" ".join(w[: n - changed] + [f"u{k}_{j}" for j in range(changed)]))

    def bands(texts):
        hashes, owner, _ = nearcopies._sets(pa.array(texts))
        return minhash(hashes, owner, len(texts))[0][:, : nearcopies.BANDS * nearcopies.ROWS].reshape(len(texts), nearcopies.BANDS, nearcopies.ROWS)

    shared = (bands(left) == bands(right)).all(2).any(1)
    assert shared.all()
