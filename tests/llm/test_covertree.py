"""Cover trees: components of any size, lengths without a pivot, and links against brute force on equidistant vectors."""

import numpy as np
from tessera.llm import covertree


def links(spark, rows, **more):
    return {r.vec_id: r for r in covertree.embedding_links(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), **more).collect()}


def test_components_of_any_size(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1e-200, 0.0]), (4, [1e200, 1e198]), (5, [0.0, 5e-324]), (6, [0.0, 1e308]), (7, [-1e-300, -1e300])]
    got = links(spark, rows)
    assert [got[k].component_id for k in range(1, 8)] == [1, 1, 1, 1, 5, 5, 7]
    assert [got[k].n_links for k in range(1, 8)] == [3, 3, 3, 3, 1, 1, 0]


def test_lengths_without_a_pivot(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=3).tolist()) for k in range(200)] + [(300, [1.0, 2.0]), (301, [1.0, 2.001]), (302, [2.0])]
    got = links(spark, rows, block=50)
    assert got[300].component_id == got[301].component_id == 300 and got[300].n_links == 1 and got[302].n_links == 0


def test_every_vector_lies_in_its_nodes():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    x = base[rng.integers(0, 40, 900)] + 0.2 * rng.normal(size=(900, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    order, levels = covertree.CoverTree.build(x)
    assert sorted(order) == list(range(900))
    y = x[order]
    for k, (centre, radius, child) in enumerate(levels):
        ends = np.append(centre[1:], 900)
        for c, z, r in zip(centre, ends, radius, strict=True):
            assert np.linalg.norm(y[c:z] - y[c], axis=1).max() <= r
        if child is not None:
            assert child[0] == 0 and child[-1] == len(levels[k + 1][0]) and (levels[k + 1][0][child[:-1]] == centre).all()
        if 0 < k <= len(covertree._RADII):  # siblings are apart by the level's radius
            for a, z in zip(levels[k - 1][2][:-1], levels[k - 1][2][1:], strict=True):
                dots = y[centre[a:z]] @ y[centre[a:z]].T
                assert (dots[~np.eye(z - a, dtype=bool)] < 1 - covertree._RADII[k - 1] ** 2 / 2 + 1e-5).all()


def test_equidistant_vectors_with_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 64))
    x[600:] = x[:100] + 0.01 * rng.normal(size=(100, 64))
    got = links(spark, list(enumerate(x.tolist())), block=128)
    assert [got[k].component_id for k in range(700)] == [*range(600), *range(100)]


def test_one_wide_node_does_not_widen_the_bound_of_all(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x[1::500] = x[::500] + 0.09 * rng.normal(size=(4, 64))
    x[2] = x[0] + 0.6 * np.linalg.norm(x[0]) / 8 * rng.normal(size=64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    order, levels = covertree.CoverTree.build(x)
    tree, looked, least = covertree.CoverTree(x[order], levels), [], np.minimum
    monkeypatch.setattr(covertree.np, "minimum", lambda a, b: looked.append(np.size(b)) or least(a, b))
    pairs = {(i, j) for p, q in covertree.near_pairs(tree, tree) for i, j in zip(p.tolist(), q.tolist(), strict=True)}
    dots = x[order] @ x[order].T
    assert set(zip(*map(np.ndarray.tolist, np.nonzero(dots >= 0.95)), strict=True)) <= pairs
    assert sum(looked) < 400_000  # of 4,000,000
