import itertools

import numpy as np
import pytest

from paritas.llm import lattice


def test_decodes_to_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * 2
    got = lattice.nearest(x) / 2
    assert len(lattice.ROOTS) == 240 and (np.square(lattice.ROOTS / 2).sum(axis=1) == 2).all()
    for g in got:
        assert (g * 2 % 2 == g[0] * 2 % 2).all() and g.sum() % 2 == 0
    best = np.square(x - got).sum(axis=1)
    for r in lattice.ROOTS / 2:  # no neighbour is nearer
        assert (np.square(x - got - r).sum(axis=1) >= best - 1e-9).all()


def data(n=400, near=0.02):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        v = rng.normal(size=64)
        rows.append(v / np.linalg.norm(v))
        for _ in range(int(rng.integers(0, 3)) if i % 3 == 0 else 0):
            w = rows[-1] + rng.normal(size=64) * near
            rows.append(w / np.linalg.norm(w) * 5)
    hot = rng.normal(size=64)
    rows += [hot + rng.normal(size=64) * 0.1 for _ in range(150)]
    rows += [rows[0]] * 40 + [hot * 3] * 30 + [rows[-1]] * 5
    return [r.astype(np.float32).tolist() for r in rows]


def brute(ids, rows, cosine):
    x = np.array(rows, dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    return {(ids[i], ids[j]) for i, j in zip(*np.nonzero(linked), strict=True)}


@pytest.mark.parametrize("block", [1024, 20])
def test_links_like_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rows = data()
    ids = [1000 - i for i in range(len(rows))]
    bad = [(2000, None), (2001, [0.0] * 64), (2002, [None] + [1.0] * 63), (2003, [float("nan")] * 64), (2004, [float("inf")] * 64), (2005, []), (2006, [1.0, 2.0])]
    df = spark.createDataFrame([*zip(ids, rows, strict=True), *bad, (ids[0], rows[0])], "vec_id long, embedding array<float>").repartition(3)
    got = {r.vec_id: r for r in lattice.near_duplicates(df).collect()}
    pairs = brute(ids, rows, lattice.COSINE)
    degree = {i: 0 for i in ids}
    for a, _ in pairs:
        degree[a] += 1
    assert sum(got[i].n_links for i in ids) >= 0.97 * len(pairs) > 9_000
    assert all(got[i].n_links <= degree[i] for i in ids)
    component = {i: i for i in ids}
    for _, (a, b) in itertools.product(range(6), sorted(pairs)):
        component[a] = component[b] = min(component[a], component[b])
    assert np.mean([got[i].component_id == component[i] for i in ids]) > 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert all(got[i].n_links == 0 and got[i].kept for i, _ in bad)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_pairs_at_the_threshold_are_mostly_found():
    rng = np.random.default_rng(2)
    a, o = rng.normal(size=(2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    cells = lattice.Cells(64)
    x, y = cells.of(a), cells.of(0.9 * a + np.sqrt(1 - 0.81) * o)
    assert ((x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)).any(axis=1).mean() > 0.92


def test_doubles_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 5), (2, [1.0, 2.1], 6), (3, [1.0, 2.0], 7), (None, [1.0, 2.0], 8), (4, [-1.0, 5.0], 9)], "vec_id int, embedding array<double>, id int")
    got = sorted(map(tuple, lattice.near_duplicates(df).collect()), key=str)
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (None, 0, None, False)]
