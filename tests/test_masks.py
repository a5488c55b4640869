import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.operators import components, geometry, morphology, pose, runs, similarity
from maskwright.sources import files


def block(h, w, boxes):
    return ["".join("#" if any(a <= y < b and c <= x < d for a, b, c, d in boxes) else "." for x in range(w)) for y in range(h)]


def test_measurements_of_small_rasters(masks):
    dims, r = masks({"square": ["###"] * 3, "two": ["##"] * 2, "ell": ["#.", "##"], "none": ["..", ".."], "dot": ["#"]})
    got = {row["mask_id"]: row for row in geometry.mask_features(dims, r).collect()}
    s = got["square"]
    expected = {
        "area": 9, "perimeter": 10.265992653082648, "solidity": 1, "bbox_width": 3, "bbox_height": 3, "extent": 1, "convex_area": 9,
        "convexity": 1, "major_axis_length": 4 * math.sqrt(2 / 3), "minor_axis_length": 4 * math.sqrt(2 / 3), "roundness": 27 / (8 * math.pi),
        "feret_diameter": 2 * math.sqrt(2), "hu_moment_1": 4 / 27, "hu_moment_2": 0, "area_power_1_5": 27, "center_vertical_occupancy": 3,
        "end_vertical_occupancy_min": 3, "end_vertical_occupancy_max": 3, "center_to_end_occupancy_ratio": 1, "centroid_x_offset": 0, "centroid_y_ratio": 0.5,
    }
    for name, value in expected.items():
        assert s[name] == pytest.approx(value, abs=1e-12), name
    assert got["two"]["perimeter"] == pytest.approx(6.47375, abs=1e-5)
    assert got["ell"]["area"] == 3 and got["ell"]["solidity"] == 1
    assert all(got["none"][f] == 0 for f in geometry.FEATURES)
    assert got["dot"]["area"] == 1 and got["dot"]["roundness"] is None


def test_scaling_to_a_longer_side(masks):
    dims, r = masks({"square": ["###"] * 3})
    one = geometry.mask_features(dims, r, 3).first()
    two = geometry.mask_features(dims, r, 6).first()
    assert two["perimeter"] == pytest.approx(2 * one["perimeter"])
    assert two["area"] == pytest.approx(4 * one["area"])
    assert two["area_power_1_5"] == pytest.approx(8 * one["area_power_1_5"])
    assert two["extent"] == one["extent"]


def test_principal_angle_and_pose(masks):
    dims, r = masks({"row": ["........."] * 2 + [".#######."] + ["........."] * 2, "diagonal": ["." * i + "#" + "." * (8 - i) for i in range(9)]})
    m = geometry.measure(r, with_hull=False)
    angles = {x["mask_id"]: x["a"] for x in m.select("mask_id", geometry.principal_angle(m).alias("a")).collect()}
    assert angles["row"] == pytest.approx(0) and angles["diagonal"] == pytest.approx(45)
    posed = geometry.measure(pose.canonical_pose(r, 16), with_hull=False)
    d = posed.where("mask_id = 'diagonal'").first()
    assert d["bbox_width"] > d["bbox_height"]


def test_angle_of_symmetric_masks_is_exact(masks):
    # tall and symmetric: the angle is the lower end of [-90, 90), not a rounding error away from the upper end
    _, r = masks({"bone": ["." * 23] * 3 + ["." * 19 + x + "." for x in ("###", ".#.", "###", "###", ".#.", ".#.")]})
    m = geometry.measure(r, with_hull=False)
    assert m.select("moment_xy", geometry.principal_angle(m).alias("a")).first() == (0.0, -90.0)


def flood(raster):
    cells = {(y, x) for y, line in enumerate(raster) for x, c in enumerate(line) if c == "#"}
    labels = {}
    for start in sorted(cells):
        if start in labels:
            continue
        stack = [start]
        while stack:
            y, x = stack.pop()
            if (y, x) in labels or (y, x) not in cells:
                continue
            labels[y, x] = start
            stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return labels


def spiral(n):
    grid = [["."] * n for _ in range(n)]
    y, x, dy, dx = 0, 0, 0, 1
    for _ in range(n * n):
        grid[y][x] = "#"
        ny, nx = y + dy, x + dx
        ahead = (ny + dy, nx + dx)
        blocked = not (0 <= ny < n and 0 <= nx < n) or (0 <= ahead[0] < n and 0 <= ahead[1] < n and grid[ahead[0]][ahead[1]] == "#")
        if blocked:
            dy, dx = dx, -dy
            ny, nx = y + dy, x + dx
            if not (0 <= ny < n and 0 <= nx < n) or grid[ny][nx] == "#":
                break
        y, x = ny, nx
    return ["".join(r) for r in grid]


@pytest.mark.parametrize("row_block", [1, 3, 256])
def test_components_match_flood_fill(masks, row_block):
    rng = random.Random(1)
    rasters = {f"m{i}": ["".join(rng.choice("##.") for _ in range(9)) for _ in range(9)] for i in range(8)} | {"spiral": spiral(15)}
    _, r = masks(rasters)
    for row in components.label_components(r, row_block=row_block).collect():
        labels = flood(rasters[row["mask_id"]])
        y, x = labels[row["y"], row["x0"]]
        # the component is named by its first run, which begins at or left of its first cell
        found = row["component"]
        assert labels[found >> 21, found & ((1 << 21) - 1)] == (y, x)
        assert found >> 21 == y


def test_component_counts_of_fixtures(masks):
    _, r = masks({"blocks": block(6, 9, [(1, 3, 1, 3), (1, 3, 5, 8)]), "diagonal": ["#.", ".#"]})
    got = {x["mask_id"]: x["components"] for x in components.component_counts(components.label_components(r)).collect()}
    assert got == {"blocks": 2, "diagonal": 2}


def test_eligibility_and_topology(masks):
    bridge = block(200, 200, [(70, 100, 40, 70), (70, 100, 130, 160), (85, 86, 70, 130)])
    dims, r = masks({"inside": block(200, 200, [(50, 150, 50, 150)]), "bridge": bridge})
    got = {x["mask_id"]: (x["status"], x["reason"]) for x in morphology.eligibility(r, dims, 200).collect()}
    assert got["inside"] == ("eligible", "")
    assert got["bridge"][0] == "rejected" and got["bridge"][1].endswith("_topology_violation")
    dims, r = masks({"edge": block(50, 50, [(1, 49, 1, 49)])})
    assert morphology.eligibility(r, dims, 50).first()["reason"] == "insufficient_expansion_margin"


def test_disk_and_shift_sizes(spark):
    df = spark.createDataFrame([(1024, 768), (512, 100), (10, 8)], "h int, w int")
    sides = [2 * x["r"] + 1 for x in df.select(morphology.disk_radius(5, 1024).alias("r")).collect()]
    assert sides == [11, 7, 3]
    assert spark.createDataFrame([(80, 100)], "h int, w int").select(morphology.shift_distance().alias("d")).first()["d"] == 5


def test_runs_round_trip_and_complement(masks):
    rng = random.Random(2)
    rasters = {f"m{i}": ["".join(rng.choice("#..") for _ in range(7)) for _ in range(5)] for i in range(5)}
    dims, r = masks(rasters)
    background = runs.runs_to_cells(runs.complement_runs(r, dims)).collect()
    for name, raster in rasters.items():
        off = {(y, x) for y, line in enumerate(raster) for x, c in enumerate(line) if c == "."}
        assert off == {(x["y"], x["x"]) for x in background if x["mask_id"] == name}


def test_augmentation_is_repeatable_and_keeps_area(masks):
    _, r = masks({f"m{i}": block(40, 40, [(3 + i, 20, 5, 25 - i)]) for i in range(6)})
    one, again = (sorted(map(tuple, morphology.augment(r, 7, 3).collect())) for _ in range(2))
    other = sorted(map(tuple, morphology.augment(r, 7, 4).collect()))
    assert one == again and one != other
    areas = {x["mask_id"]: x["a"] for x in morphology.augment(r, 7, 3).groupBy("mask_id").agg(F.sum(F.expr("x1 - x0 + 1")).alias("a")).collect()}
    assert areas == {x["mask_id"]: x["a"] for x in r.groupBy("mask_id").agg(F.sum(F.expr("x1 - x0 + 1")).alias("a")).collect()}


def random_masks(n, seed):
    rng = random.Random(seed)
    out = {}
    base = [["#" if 3 <= y < 15 and 3 <= x < 15 else "." for x in range(18)] for y in range(18)]
    for i in range(n):
        g = [row[:] for row in base]
        for _ in range(rng.choice([0, 1, 3, 12, 40])):
            y, x = rng.randrange(18), rng.randrange(18)
            g[y][x] = "." if g[y][x] == "#" else "#"
        out[f"m{i:03d}"] = ["".join(row) for row in g]
    return out


def brute_iou(rasters):
    sets = {n: {(y, x) for y, line in enumerate(r) for x, c in enumerate(line) if c == "#"} for n, r in rasters.items()}
    names = sorted(sets)
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(names) for b in names[i + 1:]}


@pytest.mark.parametrize("threshold", [0.95, 0.8])
def test_similarity_join_matches_brute_force(masks, threshold):
    rasters = {n: r for n, r in random_masks(40, 3).items()}
    distinct = {tuple(r): n for n, r in reversed(rasters.items())}
    _, r = masks({n: list(t) for t, n in distinct.items()})
    got = {(x["a"], x["b"]): x["iou"] for x in similarity.similar_contents(r, threshold).collect()}
    want = {k: v for k, v in brute_iou({n: list(t) for t, n in distinct.items()}).items() if v >= threshold}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def write_png(path, raster):
    h, w = raster.shape
    raw = b"".join(b"\0" + raster[y].tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_scan_gives_runs(spark, tmp_path):
    raster = np.zeros((5, 7), dtype=np.uint8)
    raster[1, 2:5] = raster[3, 0] = raster[3, 4:7] = 255
    write_png(tmp_path / "a.png", raster)
    raster[4, 4] = 128
    write_png(tmp_path / "b.png", raster)
    write_png(tmp_path / "c.png", np.zeros((3, 3), dtype=np.uint8))
    got = files.read_masks(spark, str(tmp_path)).collect()
    assert sorted((r["y"], r["x0"], r["x1"]) for r in got if r["mask_id"] == "a.png") == [(1, 2, 4), (3, 0, 0), (3, 4, 6)]
    assert {tuple(r["other_values"]) for r in got if r["mask_id"] == "b.png"} == {(128,)}
    assert [(r["h"], r["w"], r["y"]) for r in got if r["mask_id"] == "c.png"] == [(3, 3, None)]


@pytest.mark.parametrize("factor", [20.0, 3.0, 0.5, 0.11, 1.05])
def test_rescale_by_any_factor(masks, factor):
    rows = ["." * 60 for _ in range(60)]
    for y, a, b in [(28, 20, 33), (29, 22, 24), (29, 27, 31), (30, 28, 28)]:
        rows[y] = rows[y][:a] + "#" * (b - a + 1) + rows[y][b + 1 :]
    cells = {(y, x) for y, line in enumerate(rows) for x, c in enumerate(line) if c == "#"}
    cy, cx = sum(y for y, _ in cells) / len(cells), sum(x for _, x in cells) / len(cells)
    want = {(y, x) for y in range(60) for x in range(60) if (round(cy + (y - cy) / factor), round(cx + (x - cx) / factor)) in cells}
    dims, r = masks({"m": rows})
    out = morphology.rescale(r, factor)
    got = {(x["y"], c) for x in out.collect() for c in range(x["x0"], x["x1"] + 1)}
    assert got == want


def test_whole_masks_are_dealt_out_once(masks, monkeypatch):
    _, r = masks({f"m{k}": block(8, 9, [(1, 3 + k % 4, 2, 5 + k % 3)]) for k in range(12)})
    cores = r.sparkSession.sparkContext.defaultParallelism
    order = ["mask_id", "scenario", "y", "x0"]
    want = [tuple(row) for row in morphology.scenarios(r).orderBy(*order).collect()]
    monkeypatch.setattr(runs, "RUNS_PER_TASK", 1)
    dealt, parts = runs.by_mask(r)
    assert parts == r.count() > cores  # parts follow the runs
    got = morphology.scenarios(r)
    # widening, shrinking and shifting all follow that one shuffle
    assert "ENSURE_REQUIREMENTS" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(row) for row in got.orderBy(*order).collect()] == want
    variants = morphology.morphology_variants(dealt)
    assert "ENSURE_REQUIREMENTS" not in variants._jdf.queryExecution().executedPlan().toString()


def test_hulls_leave_a_worker_in_pieces():
    import pandas as pd

    squares = [pd.Series([np.array(c, np.int32)] * 1200) for c in ([0, 1, 2], [0, 0, 0], [2, 2, 2])]
    pieces = list(geometry.hull_udf.func(iter([tuple(squares)])))
    assert [len(p) for p in pieces] == [500, 500, 200]
    assert all([tuple(row) for row in rows] == [(0, 0, 2), (1, 0, 2), (2, 0, 2)] for p in pieces for rows in p["rows"])
