"""The 26 silhouette measurements from a run table, in one shuffle by mask.

Runs are hash-partitioned by mask once. Row summaries, the overlap with the next image row, the
bounding box and the thirds are all windows and aggregates over that same partitioning. A mask is a
single image, so the rows of a mask are bounded by its height.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.session import work_partitions

# The approved measurements in contract order, and their dimension for scaling.
FEATURES = (
    "area", "perimeter", "solidity", "circularity", "equivalent_diameter",
    "bbox_width", "bbox_height", "bbox_area", "aspect_ratio", "extent",
    "convex_area", "convexity", "major_axis_length", "minor_axis_length",
    "roundness", "feret_diameter", "hu_moment_1", "hu_moment_2",
    "area_power_1_5", "area_major_axis_product", "center_vertical_occupancy",
    "end_vertical_occupancy_min", "end_vertical_occupancy_max",
    "center_to_end_occupancy_ratio", "centroid_x_offset", "centroid_y_ratio",
)
DIMENSION = {
    "perimeter": 1, "equivalent_diameter": 1, "bbox_width": 1, "bbox_height": 1,
    "major_axis_length": 1, "minor_axis_length": 1, "feret_diameter": 1,
    "center_vertical_occupancy": 1, "end_vertical_occupancy_min": 1, "end_vertical_occupancy_max": 1,
    "area": 2, "bbox_area": 2, "convex_area": 2,
    "area_power_1_5": 3, "area_major_axis_product": 3,
}
HULL_FEATURES = ("solidity", "convex_area", "convexity", "feret_diameter")

HULL_SCHEMA = T.StructType([
    T.StructField("flat", T.BooleanType()),
    T.StructField("feret_squared", T.LongType()),
    T.StructField("vertices", T.ArrayType(T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())]))),
    T.StructField("rows", T.ArrayType(T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x0", T.IntegerType()), T.StructField("x1", T.IntegerType())]))),
])


def _chain(ys: np.ndarray, xs: np.ndarray) -> list[int]:
    """Indices of the lower convex envelope of x over y (integer cross products)."""
    kept: list[int] = []
    for i in range(len(ys)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            if (ys[b] - ys[a]) * (xs[i] - xs[a]) - (xs[b] - xs[a]) * (ys[i] - ys[a]) > 0:
                break
            kept.pop()
        kept.append(i)
    return kept


def hull_of_rows(ys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[bool, int, list, list]:
    """Convex hull of the row extremes of one mask, and the cell centres it holds in each row."""
    ys, lo, hi = (np.asarray(v, dtype=np.int64) for v in (ys, lo, hi))
    left, right = _chain(ys, lo), _chain(ys, -hi)
    vx = np.concatenate([lo[left], hi[right]])
    vy = np.concatenate([ys[left], ys[right]])
    points = np.unique(np.column_stack((vx, vy)), axis=0)
    gap = points[:, None, :] - points[None, :, :]
    feret = int((gap**2).sum(axis=2).max())
    base = points - points[0]
    far = base[int(np.argmax((base**2).sum(axis=1)))]
    flat = len(points) < 3 or not np.any(base[:, 0] * far[1] - base[:, 1] * far[0])
    vertices = [(int(x), int(y)) for x, y in points]
    if flat:
        return True, feret, vertices, []
    every = np.arange(ys[0], ys[-1] + 1)

    def ceil_envelope(chain: list[int], xs: np.ndarray) -> np.ndarray:
        cy, cx = ys[chain], xs[chain]
        at = np.clip(np.searchsorted(cy, every, side="right") - 1, 0, max(len(cy) - 2, 0))
        after = np.minimum(at + 1, len(cy) - 1)
        span = np.maximum(cy[after] - cy[at], 1)
        rise = cx[at] * span + (every - cy[at]) * (cx[after] - cx[at])
        return -((-rise) // span)

    x0, x1 = ceil_envelope(left, lo), -ceil_envelope(right, -hi)
    rows = [(int(y), int(a), int(b)) for y, a, b in zip(every, x0, x1) if a <= b]
    return False, feret, vertices, rows


#: Hulls that a Python worker holds before it hands them on.
HULLS_AT_ONCE = 500


@F.pandas_udf(HULL_SCHEMA)
def hull_udf(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Hull of each mask from its rows and their extremes, as arrays sorted by row; Arrow batches of masks, handed on in pieces."""
    for ys, lows, highs in batches:
        for at in range(0, len(ys), HULLS_AT_ONCE):
            piece = slice(at, at + HULLS_AT_ONCE)
            out = [hull_of_rows(*(np.asarray(c, np.int64) for c in mask)) for mask in zip(ys[piece], lows[piece], highs[piece])]
            yield pd.DataFrame(out, columns=["flat", "feret_squared", "vertices", "rows"])


def overlap(upper: Column, lower: Column, d: int) -> Column:
    """Cells of `upper` whose neighbour one row down and `d` to the right is in `lower`."""
    def one(s: Column, t: Column) -> Column:
        return F.greatest(F.lit(0), F.least(s["x1"], t["x1"] - d) - F.greatest(s["x0"], t["x0"] - d) + 1)

    return F.aggregate(
        upper, F.lit(0).cast("long"),
        lambda total, s: total + F.aggregate(lower, F.lit(0).cast("long"), lambda part, t: part + one(s, t)),
    )


def crofton(area: Column, runs: Column, n0: Column, n1: Column, n_1: Column) -> Column:
    """Perimeter from four directions, from the cell count, run count and neighbour overlaps."""
    straight = 2 * runs + 2 * area - 2 * n0
    diagonal = (4 * area - 2 * n1 - 2 * n_1) / math.sqrt(2.0)
    return F.lit(math.pi / 8) * (straight + diagonal)


def row_summaries(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per image row: its segments and sums, partitioned by mask."""
    n = (F.col("x1") - F.col("x0") + 1).cast("long")
    a, b = F.col("x0").cast("long"), F.col("x1").cast("long")

    def squares(m: Column) -> Column:
        return m * (m + 1) * (2 * m + 1) / 6

    return (
        runs.repartition(work_partitions(runs.sparkSession), *keys)
        .groupBy(*keys, "y")
        .agg(
            F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("segs"),
            F.sum(n).alias("n"),
            F.sum((a + b) * n / 2).alias("sx"),
            F.sum(squares(b) - squares(a - 1)).alias("sxx"),
            F.min("x0").alias("lo"),
            F.max("x1").alias("hi"),
        )
    )


def measure(runs: DataFrame, keys: list[str] | None = None, with_hull: bool = True) -> DataFrame:
    """Unscaled measurements of every mask that has foreground; `keys` identify a mask."""
    keys = keys or ["mask_id", "h", "w"]
    down = Window.partitionBy(*keys).orderBy("y")
    whole = Window.partitionBy(*keys)
    rows = row_summaries(runs, keys)
    nxt = F.lead(F.struct("y", "segs")).over(down)
    rows = (
        rows.withColumn("_next", nxt)
        .withColumn("_lower", F.when(F.col("_next.y") == F.col("y") + 1, F.col("_next.segs")).otherwise(F.slice("segs", 1, 0)))
        .withColumn("_left", F.min("lo").over(whole))
        .withColumn("_right", F.max("hi").over(whole))
    )
    width = F.col("_right") - F.col("_left") + 1
    third, extra = F.floor(width / 3), width % 3
    first_end = F.col("_left") + third + F.when(extra > 0, 1).otherwise(0)
    second_end = first_end + third + F.when(extra > 1, 1).otherwise(0)
    bounds = [(F.col("_left"), first_end), (first_end, second_end), (second_end, F.col("_right") + 1)]

    def inside(lo: Column, end: Column) -> Column:
        return F.aggregate(
            "segs", F.lit(0).cast("long"),
            lambda t, s: t + F.greatest(F.lit(0), F.least(s["x1"] + 1, end) - F.greatest(s["x0"], lo)),
        )

    y = F.col("y").cast("double")
    totals = rows.groupBy(*keys).agg(
        F.sum("n").cast("double").alias("a"),
        F.sum(F.size("segs")).cast("double").alias("r"),
        F.sum(overlap(F.col("segs"), F.col("_lower"), 0)).cast("double").alias("n0"),
        F.sum(overlap(F.col("segs"), F.col("_lower"), 1)).cast("double").alias("n1"),
        F.sum(overlap(F.col("segs"), F.col("_lower"), -1)).cast("double").alias("n_1"),
        F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx"),
        F.sum(y * F.col("n")).alias("sy"), F.sum(y * y * F.col("n")).alias("syy"), F.sum(y * F.col("sx")).alias("sxy"),
        F.min("lo").alias("left"), F.max("hi").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"),
        *[F.sum(inside(lo, end)).cast("double").alias(f"t{i}") for i, (lo, end) in enumerate(bounds)],
        *[F.max(end - lo).cast("double").alias(f"c{i}") for i, (lo, end) in enumerate(bounds)],
        F.sort_array(F.collect_list(F.struct("y", "lo", "hi"))).alias("extremes"),
    )
    return _derive(totals, keys, with_hull)


def _derive(t: DataFrame, keys: list[str], with_hull: bool) -> DataFrame:
    a = F.col("a")
    mx, my = F.col("sx") / a, F.col("sy") / a
    base = t.select(
        *keys, "a", "r", "left", "right", "top", "bottom", "extremes", "t0", "t1", "t2", "c0", "c1", "c2",
        mx.alias("mx"), my.alias("my"),
        # products of whole numbers are exact, so that the moments of a symmetric mask cancel to zero
        *[((a * F.col(f"s{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}")) / (a * a)).alias(f"v{i}{j}") for i, j in ("xx", "yy", "xy")],
        crofton(a, F.col("r"), F.col("n0"), F.col("n1"), F.col("n_1")).alias("perimeter"),
    )
    half_trace = (F.col("vxx") + F.col("vyy")) / 2
    root = F.sqrt(F.pow((F.col("vxx") - F.col("vyy")) / 2, 2) + F.col("vxy") * F.col("vxy"))
    base = base.withColumn("major", 4 * F.sqrt(F.greatest(half_trace + root, F.lit(0.0)))).withColumn(
        "minor", 4 * F.sqrt(F.greatest(half_trace - root, F.lit(0.0)))
    )
    w = (F.col("right") - F.col("left") + 1).cast("double")
    h = (F.col("bottom") - F.col("top") + 1).cast("double")
    p = F.col("perimeter")
    eta = {m: F.col(f"v{m}") / a for m in ("xx", "yy", "xy")}
    ends = [F.coalesce(F.try_divide(F.col(f"t{i}"), F.col(f"c{i}")), F.lit(0.0)) for i in range(3)]
    occupancy_sum = F.least(ends[0], ends[2]) + F.greatest(ends[0], ends[2])
    columns = {
        "area": a,
        "perimeter": p,
        "circularity": F.when(p == 0, 0.0).otherwise(F.try_divide(4 * math.pi * a, p * p)),
        "equivalent_diameter": F.sqrt(4 * a / math.pi),
        "bbox_width": w, "bbox_height": h, "bbox_area": w * h, "aspect_ratio": w / h, "extent": a / (w * h),
        "major_axis_length": F.col("major"), "minor_axis_length": F.col("minor"),
        "roundness": F.try_divide(4 * a, math.pi * F.col("major") * F.col("major")),
        "hu_moment_1": eta["xx"] + eta["yy"],
        "hu_moment_2": F.pow(eta["xx"] - eta["yy"], 2) + 4 * F.pow(eta["xy"], 2),
        "area_power_1_5": F.pow(a, 1.5),
        "area_major_axis_product": a * F.col("major"),
        "center_vertical_occupancy": ends[1],
        "end_vertical_occupancy_min": F.least(ends[0], ends[2]),
        "end_vertical_occupancy_max": F.greatest(ends[0], ends[2]),
        "center_to_end_occupancy_ratio": F.when(occupancy_sum == 0, 0.0).otherwise(F.try_divide(ends[1], occupancy_sum / 2)),
        "centroid_x_offset": F.abs((F.col("mx") - F.col("left") + 0.5) / w - 0.5),
        "centroid_y_ratio": (F.col("my") - F.col("top") + 0.5) / h,
    }
    moments = {"moment_xx": F.col("vxx"), "moment_yy": F.col("vyy"), "moment_xy": F.col("vxy"), "mean_x": F.col("mx"), "mean_y": F.col("my")}
    extra = [F.col(c) for c in ("left", "right", "top", "bottom")] + [v.alias(k) for k, v in moments.items()]
    if not with_hull:
        return base.select(*keys, *[columns[f].alias(f) for f in FEATURES if f in columns], *extra)
    hulled = base.withColumn("hull", hull_udf(*[F.col("extremes")[c] for c in ("y", "lo", "hi")]))
    rows = F.col("hull.rows")
    segments = F.transform(rows, lambda s: F.struct(s["x0"].alias("x0"), s["x1"].alias("x1")))
    hulled = hulled.withColumn("_segs", segments)
    upper, lower = F.slice("_segs", 1, F.greatest(F.size("_segs") - 1, F.lit(0))), F.slice("_segs", 2, F.greatest(F.size("_segs") - 1, F.lit(0)))

    def paired(d: int) -> Column:
        return F.aggregate(
            F.zip_with(upper, lower, lambda s, t: F.greatest(F.lit(0), F.least(s["x1"], t["x1"] - d) - F.greatest(s["x0"], t["x0"] - d) + 1)),
            F.lit(0).cast("long"), lambda acc, v: acc + v,
        ).cast("double")

    filled = F.aggregate("_segs", F.lit(0).cast("long"), lambda acc, s: acc + s["x1"] - s["x0"] + 1).cast("double")
    hulled = hulled.withColumn("_ha", filled).withColumn("_hr", F.size("_segs").cast("double")).withColumn(
        "_hp", crofton(F.col("_ha"), F.col("_hr"), paired(0), paired(1), paired(-1))
    )
    flat = F.col("hull.flat")
    convex_area = F.when(flat, a).otherwise(F.col("_ha"))
    columns |= {
        "convex_area": convex_area,
        "solidity": F.coalesce(F.try_divide(a, convex_area), F.lit(0.0)),
        "convexity": F.when(p == 0, 0.0).otherwise(F.try_divide(F.when(flat, p).otherwise(F.col("_hp")), p)),
        "feret_diameter": F.sqrt(F.col("hull.feret_squared").cast("double")),
    }
    return hulled.select(*keys, *[columns[f].alias(f) for f in FEATURES], *extra, F.col("hull.vertices").alias("hull_vertices"), F.col("hull.rows").alias("hull_rows"))


def scale(measured: DataFrame, long_side: int) -> DataFrame:
    """Bring lengths, areas and volumes to a canonical long side; ratios stay."""
    factor = F.lit(float(long_side)) / F.greatest("h", "w")
    return measured.select(*[
        (F.col(c) * F.pow(factor, F.lit(DIMENSION[c]))).alias(c) if c in DIMENSION else F.col(c) for c in measured.columns
    ])


def mask_features(dims: DataFrame, runs: DataFrame, long_side: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """All masks of `dims` with the 26 measurements in contract order; empty masks are zero."""
    keys = keys or ["mask_id", "h", "w"]
    measured = measure(runs, keys).select(*keys, *FEATURES)
    if long_side is not None:
        measured = scale(measured, long_side)
    # a measured mask keeps its NULLs (roundness of a single pixel); only absent masks become zero
    joined = dims.select(*keys).join(measured.withColumn("_m", F.lit(True)), keys, "left")
    return joined.select(*keys, *[F.when(F.col("_m").isNull(), 0.0).otherwise(F.col(f)).alias(f) for f in FEATURES])


def hull_runs(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Filled convex hull as a run table; the mask itself where the hull has no area."""
    keys = keys or ["mask_id", "h", "w"]
    measured = measure(runs, keys)
    solid = measured.where(F.size("hull_rows") > 0).select(*keys, F.inline("hull_rows"))
    flat = measured.where(F.size("hull_rows") == 0).select(*keys)
    return solid.unionByName(runs.join(flat, keys, "left_semi").select(*keys, "y", "x0", "x1"))


def principal_angle(measured: DataFrame) -> Column:
    """Principal-axis angle in degrees, wrapped to [-90, 90); 0 for fewer than two cells."""
    from maskwright.functions import wrap_angle

    angle = F.degrees(0.5 * F.atan2(2 * F.col("moment_xy"), F.col("moment_xx") - F.col("moment_yy")))
    return F.when(F.col("area") < 2, 0.0).otherwise(wrap_angle(angle))
