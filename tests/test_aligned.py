"""Aligned masks against plain loops over all pairs of rasters."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.operators import aligned, runs


def turned(raster, side):
    """Cell by cell: the definition of the canonical pose."""
    cells = [(x, y) for y, row in enumerate(raster) for x, on in enumerate(row) if on]
    if not cells:
        return np.zeros((side, side), bool)
    n, sx, sy = len(cells), sum(x for x, _ in cells), sum(y for _, y in cells)
    moment = lambda f, a, b: n * sum(f(x, y) for x, y in cells) - a * b
    xx, yy, xy = moment(lambda x, y: x * x, sx, sx), moment(lambda x, y: y * y, sy, sy), moment(lambda x, y: x * y, sx, sy)
    t = 0.5 * np.arctan2(2.0 * xy, float(xx - yy)) if n > 1 else 0.0
    t -= np.pi if t >= np.pi / 2 else 0.0
    c, s, cx, cy = np.cos(t), np.sin(t), sx / n, sy / n
    there, reach = set(cells), 2 * max(raster.shape)
    hit = {(u, v) for v in range(-reach, reach) for u in range(-reach, reach) if (int(np.floor(cx + u * c - v * s + 0.5)), int(np.floor(cy + u * s + v * c + 0.5))) in there}
    u0, v0 = min(u for u, _ in hit), min(v for _, v in hit)
    w, h = max(u for u, _ in hit) - u0 + 1, max(v for _, v in hit) - v0 + 1
    hh, ww = (max(1, round(k * min(side / w, side / h))) for k in (h, w))
    out = np.zeros((side, side), bool)
    for y in range(hh):
        for x in range(ww):
            out[y + (side - hh) // 2, x + (side - ww) // 2] = (u0 + (2 * x + 1) * w // (2 * ww), v0 + (2 * y + 1) * h // (2 * hh)) in hit
    return out


def blobs(n, seed=3, size=14):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a = np.zeros((size, size), bool)
        y, x, h, w = rng.integers(0, size // 2), rng.integers(0, size // 2), rng.integers(2, size // 2), rng.integers(2, size // 2)
        a[y : y + h, x : x + w] = True
        a ^= (rng.random((size, size)) < 0.06) & a
        a[min(y + 1, size - 1), : x + 1] |= rng.random() < 0.5
        out.append(a if a.any() else np.ones((size, size), bool))
    return out


def run_table(spark, rasters):
    rows = [(k, *r.shape, int(y), int(x)) for k, r in enumerate(rasters) for y, x in zip(*np.nonzero(r))]
    return runs.cells_to_runs(spark.createDataFrame(rows, "mask_id long, h int, w int, y int, x int"))


@pytest.fixture(scope="module")
def table(spark):
    rasters = [*blobs(40), np.ones((1, 1), bool), np.eye(9, dtype=bool), np.ones((3, 7), bool)]
    rasters += [rasters[0], rasters[0], rasters[5]]
    return rasters, aligned.canonical_bits(run_table(spark, rasters), 16).cache()


def test_pose_cell_by_cell(table):
    rasters, bits = table
    got = {r.mask_id: r for r in bits.collect()}
    for k, raster in enumerate(rasters):
        own = np.unpackbits(np.frombuffer(got[k].bits, np.uint8)).reshape(16, 16).astype(bool)
        assert (own == turned(raster, 16)).all() and got[k].area == own.sum()
    back = {(r.mask_id, r.y, x) for r in aligned.bits_to_runs(bits, 16).collect() for x in range(r.x0, r.x1 + 1)}
    assert back == {(k, y, x) for k, r in enumerate(rasters) for y, x in zip(*np.nonzero(turned(r, 16)))}


def all_pairs(rasters):
    flat = [turned(r, 16) for r in rasters]
    return {(i, j): (flat[i] & flat[j]).sum() / max(1, (flat[i] | flat[j]).sum()) for i, j in itertools.combinations(range(len(flat)), 2)}


@pytest.mark.parametrize("block, threshold", [(1024, 0.85), (7, 0.85), (5, 0.6), (4, 0.999)])
def test_similar_pairs_and_largest(spark, table, monkeypatch, block, threshold):
    monkeypatch.setattr(aligned, "BLOCK", block)
    rasters, bits = table
    distinct = bits.groupBy("bits").agg(F.min("mask_id").alias("mask_id")).select("mask_id")
    kept = {r.mask_id for r in distinct.collect()}
    want = {p: v for p, v in all_pairs(rasters).items() if set(p) <= kept}
    pairs, largest = aligned.similar(bits.join(distinct, "mask_id", "left_semi"), threshold)
    assert {(r.a, r.b): round(r.iou, 9) for r in pairs.collect()} == {p: round(v, 9) for p, v in want.items() if v >= threshold}
    assert largest.first().iou == pytest.approx(max(want.values()))


def test_masks_go_once_to_a_square_of_tiles(spark, table, monkeypatch):
    """Rows on their way to tiles: far fewer than one for each mask and tile, and no partition holds more than a few squares."""
    monkeypatch.setattr(aligned, "BLOCK", 1)
    _, bits = table
    placed, ranges = aligned._blocks(bits.select("mask_id", "bits", "area"), ["area", "mask_id"])
    n = bits.count()
    assert [aligned._square(*x) for x in ((3, 8), (20, 8), (60, 8), (5000, 12))] == [1, 2, 7, 8]
    monkeypatch.setattr(aligned, "_square", lambda blocks, cores: 8)
    masks, tiles = aligned._squares(placed, aligned._block_pairs(ranges).select("i", "j"), n)
    sides = -(-n // 8)
    assert tiles.count() == n * (n + 1) // 2 and masks.count() == n * sides
    assert masks.rdd.getNumPartitions() >= sides * (sides + 1) // 2


@pytest.mark.parametrize("block", [1024, 6])
@pytest.mark.parametrize("top", [1, 12, 5000])
def test_contradictions_by_all_pairs(spark, table, monkeypatch, block, top):
    monkeypatch.setattr(aligned, "BLOCK", block)
    rasters, bits = table
    target = {k: float((k * 37) % 19) for k in range(len(rasters))}
    rows = aligned.contradictions(bits, spark.createDataFrame([*target.items()], "mask_id long, target double"), top).collect()
    scored = [(abs(target[i] - target[j]) * v, i, j) for (i, j), v in all_pairs(rasters).items()]
    want = sorted(scored, reverse=True)[:top]
    assert [round(r.score, 9) for r in rows] == [round(s, 9) for s, _, _ in want]
    strict = want[-1][0] if len(want) == top else -1.0
    assert {(r.id_a, r.id_b) for r in rows if r.score > strict + 1e-9} == {(i, j) for s, i, j in want if s > strict + 1e-9}


def test_integrity_with_many_copies_and_without_masks(spark, table, monkeypatch):
    monkeypatch.setattr(aligned, "BLOCK", 8)
    rasters, _ = table
    rasters = [*rasters, *[rasters[3]] * 20]
    masks = run_table(spark, rasters)
    bits = aligned.canonical_bits(masks, 16)
    features = spark.createDataFrame([(k, k % 5) for k in range(len(rasters))], "mask_id long, v int")
    got = {r.test: r.value for r in aligned.integrity(runs.digests(masks), bits, features).collect()}
    pairs = all_pairs(rasters)
    raw = len({(r.shape, r.tobytes()) for r in rasters})
    assert got == {
        "duplicate_names": 0.0, "duplicate_masks": float(len(rasters) - raw), "duplicate_feature_vectors": float(len(rasters) - 5),
        "near_duplicate_pairs": float(sum(v >= 0.95 for v in pairs.values())), "maximum_iou": 1.0,
    }
    none = aligned.integrity(runs.digests(masks).where("false"), bits.where("false"), features.where("false"))
    assert {r.value for r in none.collect()} == {0.0}
    assert aligned.contradictions(bits.where("false"), features.select("mask_id", F.col("v").cast("double").alias("target")), 3).count() == 0


def test_distances_by_all_cells():
    """The envelope against the nearest of all background cells, on masks with and without background."""
    from maskwright.operators import pose

    rng = np.random.default_rng(6)
    for h, w, share in [(1, 1, 1.0), (1, 9, 0.6), (9, 1, 0.6), (12, 17, 0.5), (20, 13, 0.95), (30, 30, 0.99), (8, 8, 1.0), (25, 40, 0.8)]:
        for _ in range(5):
            mask = rng.random((h, w)) < share
            got = pose.squared_distances(mask)
            off = np.argwhere(~mask)
            for y, x in np.ndindex(h, w):
                want = ((off - [y, x]) ** 2).sum(1).min() if len(off) else np.inf
                assert got[y, x] == want


def test_edges_and_distances_of_run_tables(spark):
    from maskwright.operators import pose

    rasters = [*blobs(12, seed=9), np.ones((4, 4), bool)]
    table = run_table(spark, rasters)
    edges = {(r.mask_id, r.y, x) for r in pose.edge_runs(table).collect() for x in range(r.x0, r.x1 + 1)}
    pad = [np.pad(r, 1) for r in rasters]
    assert edges == {(k, y, x) for k, r in enumerate(rasters) for y, x in zip(*np.nonzero(r)) if not all(pad[k][y + 1 + dy, x + 1 + dx] for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))}
    got = {(r.mask_id, r.y, r.x): r.distance for r in pose.distance_channel(table).collect()}
    want = {}
    for k, r in enumerate(rasters[:-1]):
        d = np.sqrt(pose.squared_distances(r))
        if not r.all():
            want |= {(k, y, x): d[y, x] / d[r].max() for y, x in zip(*np.nonzero(r))}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(v) for c, v in want.items())
