"""Centroid clustering and whitening against plain numpy."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import QUERIES, orchard, whitening
from tracewell.llm import vectors as V

VECTORS = "vec_id long, embedding array<double>, label int"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(3)


def odd_columns(df):
    return df.withColumns({c: F.lit(7) for c in ("row", "x", "in", "hash", "cluster", "near", "white", "n", "distance")})


def points(n, dims, seed=1, groups=5):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (groups, dims))
    return (centres[r.integers(0, groups, n)] + r.normal(0, 0.2, (n, dims))).round(3).tolist()


def usable(v, dims):
    return v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)


ODD_VECTORS = [None, [], [1.0], [None] * 6, [math.nan] + [0.0] * 5, [math.inf] + [0.0] * 5, [-math.inf] * 6, [-0.0] * 6, [0.5] * 7]

# --- Orchard -----------------------------------------------------------------


def clusters_by_hand(rows, dims, k, rounds, seed=3, scale=1024):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if usable(v, dims)]
    if not kept:
        return {}
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), np.array(r[1], "<i8").tobytes()))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else old for j, old in enumerate(centroids)]
    found = sorted((-1 if i is None else i, *near(v)[::-1]) for i, v in kept)
    total = {j: sum(d for _, c, d in found if c == j) for j in range(len(centroids))}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, total[c], sum(total.values()), shas[c]) for i, c, d in found]


FIELDS = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("k, rounds", [(8, 10), (1, 2), (40, 3)])
def test_clusters_like_brute_force(table, k, rounds):
    rows = list(enumerate(points(300, 6)))
    rows += [(i, v) for i, v in rows[:60]] + [(None, rows[3][1]), (None, rows[3][1])] + [(1000 + i, rows[5][1]) for i in range(150)]
    rows += [(2000 + i, v) for i, v in enumerate(ODD_VECTORS)]
    out = orchard.clustered(odd_columns(table(rows)), k=k, rounds=rounds, dims=6)
    got = sorted((-1 if x.vec_id is None else x.vec_id, *(x.near[f] for f in FIELDS)) for x in out.collect())
    assert got == clusters_by_hand(rows, 6, k, rounds)
    assert out.columns == [*[c for c in odd_columns(table([])).columns if c != "near"], "near"]


def test_clusters_of_few_and_none(table):
    assert orchard.clustered(table([])).collect() == []
    assert orchard.clustered(table([(1, None), (2, [1.0])])).collect() == []
    rows = [(i, [float(i), 1.0]) for i in range(3)]
    out = orchard.clustered(table(rows), dims=2).collect()
    assert {x.near.distance for x in out} == {0} and len({x.near.cluster for x in out}) == 3
    with pytest.raises(ValueError):
        orchard.clustered(table(rows), k=orchard.MOST_CENTROIDS + 1)


def test_orchard_finds_the_nearest_with_fewer_distances():
    r = np.random.default_rng(5)
    centres = r.integers(-3000, 3000, (30, 16))
    centroids = (centres[:, None] + r.integers(-200, 200, (30, 10, 16))).reshape(-1, 16)
    centroids[17] = centroids[200]  # a tie
    x = centroids[r.integers(0, 300, 2000)] + r.integers(-100, 100, (2000, 16))
    search = orchard.Orchard(centroids)
    best, distance = search.nearest(x)
    every = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert search.measured < 0.4 * every.size


def test_orchard_keeps_ties_at_twice_the_distance():
    """The smaller number wins although it lies exactly at twice the distance."""
    search = orchard.Orchard(np.array([[9, 9], [4, 0], [0, 0], [100, 100]]))
    best, distance = search.nearest(np.array([[2, 0]]))
    assert (best[0], distance[0]) == (1, 4)


def test_clusters_of_huge_components(table):
    with pytest.raises(Exception, match="beyond"):
        orchard.clustered(table([(1, [1e30] * 6)]), dims=6).collect()
    edge = orchard.largest_component(6)
    x = np.array([[edge] * 6, [-edge] * 6])
    assert orchard.Orchard(x[:1]).nearest(x)[1].tolist() == [0, 6 * (2 * edge) ** 2]


# --- whitening ---------------------------------------------------------------


def whitened_by_hand(rows, dims, wanted=4, scale=256):
    kept = [(i, [math.floor(scale * c) + 0 for c in v]) for i, v in rows if usable(v, dims)]
    fit = np.array(sorted({tuple(v) for _, v in kept}))
    n, sums = len(fit), fit.sum(axis=0)
    values, components = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, components = values[::-1][:wanted], components[:, ::-1][:, :wanted]
    white = [(np.array(v) - sums / n) @ components / np.sqrt(values) for _, v in kept]
    deviation = [sum((n * c - int(s)) ** 2 for c, s in zip(v, sums)) for _, v in kept]
    return n, kept, values, components, white, deviation, values / np.trace(np.cov(fit.T, bias=True))


def test_whitening_like_eigh(table):
    rows = list(enumerate(points(400, 12, seed=3)))
    rows += rows[:50] + [(None, rows[7][1])] * 2 + [(1000 + i, rows[9][1]) for i in range(200)] + [(2000 + i, v) for i, v in enumerate(ODD_VECTORS)]
    out = sorted(whitening.whitened(odd_columns(table(rows))).collect(), key=lambda x: (x.vec_id is None, x.vec_id, x.embedding))
    n, kept, values, components, white, deviation, explained = whitened_by_hand(rows, 12)
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0))
    assert [x.vec_id for x in out] == [kept[j][0] for j in order]
    assert {x.white.n for x in out} == {n} and [x.white.deviation for x in out] == [deviation[j] for j in order]
    got, want = np.array([x.white.whitened for x in out]), np.array([white[j] for j in order])
    assert np.abs(got - want * np.sign((got * want).sum(axis=0))).max() < 1e-9
    assert np.allclose(out[0].white.explained, explained, rtol=1e-10) and out[0].white.identity_error < 1e-10
    fit = whitening.fitted(table(rows))
    assert np.abs(fit.components.T @ fit.components - np.eye(4)).max() < 1e-13 and fit.residuals.max() < 1e-13


def test_whitening_of_the_table(spark):
    rows = [(x.vec_id, x.embedding) for x in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = QUERIES["op13_embedding_whitening"](spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    n, kept, _, _, white, deviation, explained = whitened_by_hand(rows, 64)
    order = np.argsort([i for i, _ in kept])
    found = got.whitened.to_numpy().reshape(len(kept), 4)
    want = np.array(white)[order]
    assert np.abs(found - want * np.sign((found * want).sum(axis=0))).max() < 1e-7
    assert got.deviation.to_numpy()[::4].tolist() == [deviation[j] for j in order]
    assert np.allclose(got.explained.to_numpy()[:4], explained, rtol=1e-9) and (got.n == n).all() and got.identity_error.max() < 1e-9


@pytest.mark.parametrize("kind", ["gap", "flat", "ties", "low rank", "narrow"])
def test_pairs_of_many_spectra(kind):
    r = np.random.default_rng(8)
    dims = 5 if kind == "narrow" else 150
    spectrum = {
        "gap": np.r_[1000, 500, 100, 50, np.linspace(3, 1, 146)], "flat": np.linspace(1.1, 1, 150),
        "ties": np.r_[[7.0] * 3, [5.0] * 4, np.linspace(2, 0.1, 143)], "low rank": np.r_[4, 3, np.zeros(148)], "narrow": np.arange(5, 0, -1.0),
    }[kind]
    turn, _ = np.linalg.qr(r.normal(size=(dims, dims)))
    passes = []

    def product(x):
        passes.append(x.shape[1])
        return turn @ (spectrum[:, None] * (turn.T @ x))

    values, components, residuals = whitening.largest_pairs(product, dims, 4)
    assert np.abs(values - spectrum[:4]).max() < 1e-12 * spectrum[0] and residuals.max() < 1e-11
    assert np.abs(components.T @ components - np.eye(4)).max() < 1e-13
    assert max(passes) <= 6 and len(passes) < 330


def test_minres_solves(seed=4):
    r = np.random.default_rng(seed)
    a = r.normal(size=(20, 20))
    a = a + a.T
    right, shifts = r.normal(size=(20, 3)), np.array([0.3, -2.0, 11.0])
    found = whitening.minres(lambda x: a @ x, shifts, right, lambda x: x, 21)
    for j in range(3):
        assert np.allclose((a - shifts[j] * np.eye(20)) @ found[:, j], right[:, j], atol=1e-6)


def test_whitening_of_few_and_none(table):
    assert whitening.whitened(table([])).collect() == [] and whitening.whitened(table([(1, None), (2, [None])])).collect() == []
    assert whitening.whitened(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    out = whitening.whitened(table([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [3.0, 2.0])])).collect()
    assert len(out) == 3 and all(len(x.white.whitened) == 1 and abs(abs(x.white.whitened[0]) - 1) < 1e-12 for x in out)


def test_deviation_beyond_a_long():
    x = np.array([[2**40, 0], [3, 4]])
    assert whitening._deviations(x, 2, [0, 0]) == [None, 100]
    assert whitening._deviations(x[1:], 2, [1, 1]) == [74]


def test_bytes_of_vectors():
    x = np.array([[1, -2], [3, 1 << 60]])
    assert (V.from_bytes(V.as_bytes(x), 2) == x).all() and (V.from_bytes(V.as_bytes(x).slice(1), 2) == x[1:]).all()
    assert V.from_bytes(V.as_bytes(x[:0]), 2).shape == (0, 2)
