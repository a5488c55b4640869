"""Nearest neighbours and components against plain linear algebra."""

import numpy as np
import pytest

from maskwright.operators import neighbours


def plain(points):
    out = {}
    for i, p in points.items():
        best = min(((round(float(np.sqrt(((p - q) ** 2).sum())), 9), j) for j, q in points.items() if j != i), default=None)
        if best:
            out[i] = (best[1], best[0])
    return out


@pytest.mark.parametrize("block, probes", [(1024, 4096), (16, 8)])
@pytest.mark.parametrize("kind", ["clusters", "spread", "line", "one_place"])
def test_matches_all_pairs(spark, monkeypatch, block, probes, kind):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "PROBES", probes)
    rng = np.random.default_rng(5)
    v = {
        "clusters": lambda: rng.integers(0, 4, (300, 1)) * 10.0 + rng.normal(size=(300, 12)) * 0.3, "spread": lambda: rng.normal(size=(250, 12)),
        "line": lambda: np.outer(np.arange(200) ** 1.5, np.ones(12)), "one_place": lambda: np.where(np.arange(240)[:, None] < 80, 1.0, rng.normal(size=(240, 12)) * 1e-3),
    }[kind]()
    v = np.round(v, 6)
    points = {1000 - k: x for k, x in enumerate(v)}
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in points.items()], "mask_id long, v array<double>").repartition(3)
    got = {r.mask_id: (r.neighbour, round(r.distance, 9)) for r in neighbours.nearest_neighbours(frame, "mask_id").collect()}
    assert got == plain(points)


def test_points_go_once_to_a_region(spark, monkeypatch):
    """In many even dimensions every block is visited; a point is sent to each region of blocks, not to each block."""
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    stored = []
    inner = neighbours.materialize
    monkeypatch.setattr(neighbours, "materialize", lambda df: stored.append(inner(df)) or stored[-1])
    v = np.random.default_rng(7).normal(size=(200, 30))
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "mask_id long, v array<double>").repartition(3)
    got = {r.mask_id: (r.neighbour, round(r.distance, 9)) for r in neighbours.nearest_neighbours(frame, "mask_id").collect()}
    assert got == plain(dict(enumerate(v)))
    assert stored[-1][0].count() <= 200 * 200 / 4 / 4


def test_few_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "mask_id long, v array<double>")
    assert neighbours.nearest_neighbours(frame([]), "mask_id").count() == 0
    assert neighbours.nearest_neighbours(frame([(1, [0.0])]), "mask_id").count() == 0
    same = neighbours.nearest_neighbours(frame([(4, [1.0]), (2, [1.0]), (9, [1.0])]), "mask_id").collect()
    assert sorted((r.mask_id, r.neighbour, r.distance) for r in same) == [(2, 4, 0.0), (4, 2, 0.0), (9, 2, 0.0)]


def rasters(spark, n=160, cells=64):
    rng = np.random.default_rng(2)
    base = rng.random((6, cells)) < 0.4
    x = (base[rng.integers(0, 6, n)] ^ (rng.random((n, cells)) < 0.08)).astype(np.uint8)
    return x, spark.createDataFrame([(k, np.packbits(r).tobytes()) for k, r in enumerate(x)], "mask_id long, bits binary").repartition(4)


def test_components_equal_those_of_the_whole_covariance(spark):
    x, bits = rasters(spark)
    c = neighbours.principal_components(bits, 5, 64)
    values, vectors = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    assert c.variances == pytest.approx(values[::-1][:5], abs=1e-6) and c.total == pytest.approx(values.sum())
    assert np.abs(np.abs((c.directions * vectors[:, ::-1][:, :5]).sum(0)) - 1).max() < 1e-4
    y = {r.mask_id: r.parts for r in neighbours.projected(bits, c, "mask_id", "parts").collect()}
    assert np.allclose([y[k] for k in range(len(x))], (x - x.mean(0)) @ c.directions)
    none = neighbours.principal_components(bits.where("false"), 5, 64)
    assert none.total == 0 and none.variances.tolist() == [0.0] * 5


def test_full_representation_by_brute_force(spark):
    x, bits = rasters(spark)
    _, other = rasters(spark, cells=64)
    size = spark.createDataFrame([(k, float(r.sum()), 3.0) for k, r in enumerate(x)], "mask_id long, area double, flat double")
    v = neighbours.full_representation(size, ["area", "flat"], bits, other, raw_parts=4, canonical_parts=3, cells=64)
    own = {r.mask_id: np.array(r.v) for r in v.collect()}
    whole = np.array([own[k] for k in range(len(x))])
    assert whole.shape == (len(x), 9) and np.allclose(whole.mean(0), 0) and np.allclose(whole.std(0), [1, 0, *[1] * 7])
    got = {r.mask_id: (r.neighbour, round(r.distance, 9)) for r in neighbours.nearest_neighbours(v, "mask_id").collect()}
    assert got == plain(own)
