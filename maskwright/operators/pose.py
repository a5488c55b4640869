"""Resizing, canonical pose and geometry channels of masks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import half_even
from maskwright.operators import morphology
from maskwright.operators.geometry import measure, principal_angle
from maskwright.operators.runs import KEYS, cells_to_runs, merge_runs


def resized_size(side: int, mode: str) -> tuple[Column, Column]:
    """(height, width) of the resized image: the frame itself, or scaled to fit inside it."""
    if mode == "stretch":
        return F.lit(side), F.lit(side)
    if mode != "letterbox":
        raise ValueError(f"resize mode was {mode!r}; expected 'letterbox' or 'stretch'")
    factor = F.least(F.lit(float(side)) / F.col("w"), F.lit(float(side)) / F.col("h"))
    return tuple(F.greatest(half_even(F.col(c) * factor), F.lit(1.0)).cast("int") for c in ("h", "w"))


def _first_hit(position: Column, source: Column, destination: Column) -> Column:
    """Smallest destination index whose nearest source index is at least `position`."""
    return F.ceil((2 * destination * position - source) / (2.0 * source)).cast("int")


def resize(runs: DataFrame, side: int, mode: str = "letterbox", keys: list[str] | None = None) -> DataFrame:
    """Nearest-neighbour resize to side x side, letterboxed in the middle or stretched.

    Destination index i reads source index floor((i + 0.5) * source / destination), which is
    monotone, so a run maps to one run in each destination row that reads its row.
    """
    keys = keys or KEYS
    others = [k for k in keys if k not in ("h", "w")]
    hh, ww = resized_size(side, mode)
    sized = runs.withColumn("_hh", hh).withColumn("_ww", ww)
    y0, y1 = _first_hit(F.col("y"), F.col("h"), F.col("_hh")), _first_hit(F.col("y") + 1, F.col("h"), F.col("_hh")) - 1
    a, b = _first_hit(F.col("x0"), F.col("w"), F.col("_ww")), _first_hit(F.col("x1") + 1, F.col("w"), F.col("_ww")) - 1
    top, left = F.expr(f"({side} - _hh) div 2").cast("int"), F.expr(f"({side} - _ww) div 2").cast("int")
    placed = sized.withColumn("_y0", y0).withColumn("_y1", y1).withColumn("_a", a).withColumn("_b", b).where("_y0 <= _y1 AND _a <= _b")
    rows = placed.select(
        *others, F.lit(side).alias("h"), F.lit(side).alias("w"), F.explode(F.sequence("_y0", "_y1")).alias("_y"), "_a", "_b", top.alias("_t"), left.alias("_l")
    )
    moved = rows.select(*others, "h", "w", (F.col("_y") + F.col("_t")).alias("y"), (F.col("_a") + F.col("_l")).alias("x0"), (F.col("_b") + F.col("_l")).alias("x1"))
    return merge_runs(moved, [*others, "h", "w"])


def canonical_pose(runs: DataFrame, side: int, mode: str = "letterbox") -> DataFrame:
    """Rotate the principal axis to horizontal, crop to the foreground and resize.

    Every cell of the rotated bounding box looks up its nearest source cell, so the result has no
    gaps. Masks are expected at working size (resize large photographs first).
    """
    measured = measure(runs, KEYS, with_hull=False)
    turned = measured.select(
        *KEYS, F.radians(principal_angle(measured)).alias("t"), F.col("mean_x").alias("cx"), F.col("mean_y").alias("cy"),
        "left", "right", "top", "bottom",
    )
    c, s = F.cos("t"), F.sin("t")
    corners = [(F.col(x) - F.col("cx"), F.col(y) - F.col("cy")) for x in ("left", "right") for y in ("top", "bottom")]
    us, vs = [x * c + y * s for x, y in corners], [y * c - x * s for x, y in corners]
    box = turned.select(
        *KEYS, "t", "cx", "cy",
        F.floor(F.least(*us)).cast("int").alias("u0"), F.ceil(F.greatest(*us)).cast("int").alias("u1"),
        F.floor(F.least(*vs)).cast("int").alias("v0"), F.ceil(F.greatest(*vs)).cast("int").alias("v1"),
    )
    grid = box.select(*KEYS, "t", "cx", "cy", "u0", "u1", "v0", F.explode(F.sequence("v0", "v1")).alias("v")).select(
        *KEYS, "t", "cx", "cy", "u0", "v0", "v", F.explode(F.sequence("u0", "u1")).alias("u")
    )
    c, s = F.cos("t"), F.sin("t")
    source_x = F.floor(F.col("cx") + F.col("u") * c - F.col("v") * s + 0.5).cast("int")
    source_y = F.floor(F.col("cy") + F.col("u") * s + F.col("v") * c + 0.5).cast("int")
    looked = grid.select(*KEYS, "u", "v", source_x.alias("sx"), source_y.alias("y"))
    hit = looked.join(runs.select(*KEYS, "y", "x0", "x1"), [*KEYS, "y"]).where((F.col("sx") >= F.col("x0")) & (F.col("sx") <= F.col("x1")))
    whole = Window.partitionBy("mask_id")
    cropped = hit.select(
        "mask_id", "u", "v", F.min("u").over(whole).alias("u0"), F.max("u").over(whole).alias("u1"), F.min("v").over(whole).alias("v0"), F.max("v").over(whole).alias("v1")
    ).select(
        "mask_id", (F.col("v1") - F.col("v0") + 1).alias("h"), (F.col("u1") - F.col("u0") + 1).alias("w"),
        (F.col("v") - F.col("v0")).alias("y"), (F.col("u") - F.col("u0")).alias("x"),
    )
    return resize(cells_to_runs(cropped), side, mode)


def rotate(runs: DataFrame, degrees: float, keys: list[str] | None = None) -> DataFrame:
    """Turn every mask about the centre of its frame, frame kept; cells look up their nearest source.

    A mask is turned as one raster in its task: its cells never are rows, and no side of a join holds them.
    """
    keys = keys or KEYS
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    whole = runs.groupBy(*keys).agg(F.collect_list(F.struct(F.col("y").cast("int"), F.col("x0").cast("int"), F.col("x1").cast("int"))).alias("runs"))
    height, width = keys.index("h"), keys.index("w")

    def sources(h: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cy, cx = (h - 1) / 2.0, (w - 1) / 2.0
        dv, du = np.arange(h)[:, None] - cy, np.arange(w)[None, :] - cx
        x, y = np.floor(cx + du * c - dv * s + 0.5).astype(int), np.floor(cy + du * s + dv * c + 0.5).astype(int)
        inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        return np.where(inside, y, 0), np.where(inside, x, 0), inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            at, found = [], []
            for k, (h, w, own) in enumerate(zip(batch.column(height).to_pylist(), batch.column(width).to_pylist(), batch.column(len(keys)))):
                if (h, w) not in known:
                    known = {(h, w): sources(h, w)} if len(known) >= 64 else {**known, (h, w): sources(h, w)}
                y, x, inside = known[h, w]
                edge = np.zeros((h, w + 1), np.int32)
                row, x0, x1 = (own.values.field(i).to_numpy() for i in range(3))
                np.add.at(edge, (row, x0), 1)
                np.add.at(edge, (row, x1 + 1), -1)
                turned = (np.cumsum(edge, axis=1) > 0)[y, x] & inside
                edge = np.diff(np.pad(turned, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                row, x0 = np.nonzero(edge == 1)
                at.append(np.full(len(row), k))
                found.append(np.stack([row, x0, np.nonzero(edge == -1)[1] - 1]))
            if at:
                of, parts = pa.array(np.concatenate(at)), np.concatenate(found, 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(of) for i in range(len(keys))], *[pa.array(p) for p in parts]], names=[*keys, "y", "x0", "x1"])

    fields = [runs.schema[k] for k in keys] + [T.StructField(n, T.IntegerType()) for n in ("y", "x0", "x1")]
    return whole.mapInArrow(run, T.StructType(fields))


def pixel_vectors(runs: DataFrame, side: int, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the side x side raster of each mask as an array of 0.0 and 1.0."""
    cells = runs.select(*keys, F.explode(F.sequence("x0", "x1")).alias("x"), "y")
    lit = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct(F.col("y") * side + F.col("x"), F.lit(1.0)))).alias("_m"))
    positions = F.sequence(F.lit(0), F.lit(side * side - 1))
    return lit.select(*keys, F.transform(positions, lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0))).alias(name))


def edge_runs(runs: DataFrame) -> DataFrame:
    """Cells of the mask that a one-step contraction removes, run by run: what of a run lies outside the inner ones."""
    inner = morphology.contract(runs, morphology.diamond_rows(1)).select(*KEYS, "y", F.struct("x0", "x1").alias("hole"))
    holes = inner.groupBy(*KEYS, "y").agg(F.sort_array(F.collect_list("hole")).alias("holes"))
    rows = runs.select(*KEYS, "y", "x0", "x1").join(holes, [*KEYS, "y"], "left")
    inside = F.filter(F.coalesce("holes", F.array().cast("array<struct<x0:int,x1:int>>")), lambda h: (h["x0"] >= F.col("x0")) & (h["x1"] <= F.col("x1")))
    # the gaps before the first hole, between holes, and behind the last one
    starts = F.concat(F.array("x0"), F.transform("inside", lambda h: (h["x1"] + 1).cast("int")))
    ends = F.concat(F.transform("inside", lambda h: (h["x0"] - 1).cast("int")), F.array("x1"))
    gaps = F.zip_with("starts", "ends", lambda a, b: F.struct(a.alias("x0"), b.alias("x1")))
    cut = rows.withColumn("inside", inside).withColumn("starts", starts).withColumn("ends", ends)
    return cut.select(*KEYS, "y", F.inline(F.filter(gaps, lambda g: g["x0"] <= g["x1"])))


def squared_distances(mask: np.ndarray) -> np.ndarray:
    """Squared distance of every cell to the nearest background cell inside the frame; infinite where there is none.

    First the nearest background in the same column, both ways; then along each row the lower envelope of the parabolas
    that stand on the columns, built and read from left to right for all rows together. Every parabola enters and leaves
    a row's envelope once.
    """
    h, w = mask.shape
    gap = np.where(mask, np.inf, 0.0)
    for y in range(1, h):
        gap[y] = np.minimum(gap[y], gap[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        gap[y] = np.minimum(gap[y], gap[y + 1] + 1)
    height = gap**2
    place = np.zeros((h, w), int)  # columns whose parabolas are on the envelope
    begin = np.full((h, w + 1), np.inf)  # where each of them begins to be the lowest
    size = np.zeros(h, int)
    rows = np.arange(h)
    for x in range(w):
        live = np.isfinite(height[:, x])
        while live.any():
            r = rows[live & (size > 0)]
            if not len(r):
                break
            top = place[r, size[r] - 1]
            meet = ((height[r, x] + x * x) - (height[r, top] + top * top)) / (2.0 * (x - top))
            gone = meet <= begin[r, size[r] - 1]
            size[r[gone]] -= 1
            if not gone.any():
                break
            live = live & np.isin(rows, r[gone])
        r = rows[np.isfinite(height[:, x])]
        some = r[size[r] > 0]
        top = place[some, size[some] - 1]
        begin[r, size[r]] = -np.inf
        begin[some, size[some]] = ((height[some, x] + x * x) - (height[some, top] + top * top)) / (2.0 * (x - top))
        place[r, size[r]] = x
        size[r] += 1
    out = np.full((h, w), np.inf)
    at = np.zeros(h, int)
    known = rows[size > 0]
    for x in range(w):
        r = known
        while len(r):
            r = r[(at[r] + 1 < size[r])]
            r = r[begin[r, at[r] + 1] < x]
            at[r] += 1
        at_ = place[known, at[known]]
        out[known, x] = (x - at_) ** 2 + height[known, at_]
    return out


def distance_runs(runs: DataFrame) -> DataFrame:
    """(keys, y, x0, x1, distances): the normalised distance to the background of every cell of a run, in order.

    Distances are divided by the mask's largest; the frame is not background, and a mask without any has no distances
    (NULL). A mask is one row of its runs in the kernel, and leaves it as runs.
    """
    whole = runs.select(*KEYS, "y", "x0", "x1").groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("y", "x0", "x1"))).alias("runs"))
    types = dict(runs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                h, w = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                own = batch.column(3)[k].values
                y, x0, x1 = (own.field(i).to_numpy() for i in range(3))
                edge = np.zeros((h, w + 1), np.int32)
                np.add.at(edge, (y, x0), 1)
                np.add.at(edge, (y, x1 + 1), -1)
                mask = np.cumsum(edge, axis=1)[:, :w] > 0
                d = np.sqrt(squared_distances(mask))
                top = d[mask].max()
                found = [(d[r, a : b + 1] / top).tolist() if np.isfinite(top) else None for r, a, b in zip(y, x0, x1)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(pa.array(np.full(len(y), k))) for c in range(3)], *[own.field(i) for i in range(3)], pa.array(found, pa.list_(pa.float64()))],
                    names=[*KEYS, "y", "x0", "x1", "distances"],
                )

    return whole.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in (*KEYS, "y", "x0", "x1")) + ", distances array<double>")


def distance_channel(runs: DataFrame) -> DataFrame:
    """(keys, y, x, distance) of every foreground cell that has a distance."""
    return distance_runs(runs).select(*KEYS, "y", "x0", F.posexplode("distances").alias("k", "distance")).select(*KEYS, "y", (F.col("x0") + F.col("k")).alias("x"), "distance")
