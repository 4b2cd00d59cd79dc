import itertools

import numpy as np
import pytest

from orrery.llm import lattice as E

from .test_ngram_and_lines import components


def test_nearest_points():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(200, 8)) * 1.5
    near = E.nearest_e8(y)
    whole = np.all(near == np.rint(near), axis=1) | np.all(near - 0.5 == np.rint(near - 0.5), axis=1)
    assert whole.all() and (near.sum(axis=1) % 2 == 0).all()
    for a, b in zip(y, near):  # no neighbour is nearer
        assert ((a - b) ** 2).sum() <= ((a - (b + E.ROOTS)) ** 2).sum(axis=1).min() + 1e-9
    assert len(E.ROOTS) == 240 and np.allclose((E.ROOTS**2).sum(axis=1), 2)


@pytest.mark.parametrize("rung", E.LADDER)
def test_recall_on_every_rung(rung):
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=(2, 1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for cosine, least in ((0.9, 0.965), (0.95, 0.995)):
        a, b = E.cells(x, *rung[1:]), E.cells(cosine * x + np.sqrt(1 - cosine**2) * z, *rung[1:])
        assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= least


def test_the_share_of_pairs_compared_falls():
    x = np.random.default_rng(4).normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shares = []
    for _, *rung in E.LADDER:
        counts = np.unique(E.cells(x, *rung).ravel(), return_counts=True)[1].astype(float)
        shares.append((counts * (counts - 1)).sum() / (len(x) * (len(x) - 1)))
    assert shares[0] < 0.04 and all(b < a * 0.7 or a < 1e-5 for a, b in zip(shares, shares[1:]))
    assert E.ladder(0)[0] == 1 and E.ladder(10**12) == E.LADDER[-1][1:]


def clusters(rng, groups, size, spread):
    out = []
    for _ in range(groups):
        centre = rng.normal(size=32)
        out += [centre + rng.normal(size=32) * spread for _ in range(size)]
    return out


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = [list(map(float, v)) for v in clusters(rng, 6, 12, 0.15) + clusters(rng, 30, 1, 0.1)]
    x += [x[0]] * 5 + [[2 * v for v in x[0]]]
    rows = [(k, v, k % 3) for k, v in enumerate(x)]
    odd = [(500, None, 0), (501, [0.0] * 32, 0), (502, [float("nan")] * 32, 0), (503, [None] + [1.0] * 31, 0), (504, [], 0), (505, [float("inf")] + [0.0] * 31, 0), (506, [1.0, 0.0], 0), (507, [1.0, 1e-9], 0)]
    for kind, rung in (("double", {}), ("float", {}), ("float", dict(zip(("blocks", "scale", "tables"), E.LADDER[1][1:])))):
        vectors = spark.createDataFrame(rows + odd + [(None, x[0], 0)], f"vec_id long, embedding array<{kind}>, kept int")
        found = {r["vec_id"]: r for r in E.near_vectors(vectors, block=5, **rung).collect()}
        assert len(found) == len(rows) + len(odd) + 1
        v = np.array(x).astype("f4" if kind == "float" else "f8").astype("f8")
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        linked = v @ v.T >= 0.9
        np.fill_diagonal(linked, False)
        near = components(range(len(x)), [(a, b) for a, b in itertools.combinations(range(len(x)), 2) if linked[a, b]])
        got = np.array([found[k]["n_links"] for k in range(len(x))])
        assert (got <= linked.sum(axis=1)).all() and got.sum() >= 0.98 * linked.sum()
        assert sum(found[k]["component_id"] != near[k] for k in range(len(x))) <= 1
        assert all(found[k]["kept"] == (found[k]["component_id"] == k) for k in range(len(x)))
        assert all(found[k]["n_links"] == 0 and found[k]["kept"] for k, _, _ in odd[:6])
        assert found[506]["n_links"] == 1 and found[507]["component_id"] == 506
        assert found[None]["n_links"] == 0 and found[None]["component_id"] is None
    assert E.near_vectors(vectors.limit(0)).count() == 0


def test_repeated_rows_count(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_rows_of_one_id_with_unlike_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [1.0, 0.02, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 0.0, 1.0]), (1, [0.0, 0.01, 1.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1)]
