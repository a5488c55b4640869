"""Similar masks on their own frames, and what neighbours say about targets. Aligned masks: aligned.py; the search for neighbours: neighbours.py."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.metrics import attach_percentiles
from maskwright.operators.runs import intersect_runs
from maskwright.session import materialize, work_partitions


GRID = 6
SALTS = 4


def size_class(area: Column, threshold: float) -> Column:
    """Geometric size class: masks at or above the threshold are at most one class apart."""
    return F.floor(F.log(area.cast("double")) / F.lit(math.log(1 / threshold)) + F.lit(1e-9)).cast("int")


def largest_difference(size_class_: Column, threshold: float) -> Column:
    """Cells in which a mask of the class and a larger one may differ: (1 - t) / t * |smaller|."""
    largest = F.pow(F.lit(1 / threshold), (size_class_ + 1).cast("double"))
    return largest * F.lit((1 - threshold) / threshold) + F.lit(1e-6)


def profiles(runs: DataFrame, key: str = "mask_id") -> DataFrame:
    """(key, area, upper, left, coarse): cell counts of the mask, of two halves, and of a raster of GRID x GRID blocks."""
    n = F.col("x1") - F.col("x0") + 1

    def inside(k: Column) -> Column:
        start, stop = F.floor(k * F.col("w") / GRID), F.floor((k + 1) * F.col("w") / GRID)
        return F.greatest(F.lit(0), F.least(F.col("x1") + 1, stop) - F.greatest(F.col("x0"), start))

    band = F.least(F.floor(F.col("y") * GRID / F.col("h")), F.lit(GRID - 1)).cast("int")
    rows = runs.select(
        key, n.alias("n"), F.when(F.col("y") * 2 < F.col("h"), n).otherwise(0).alias("up"),
        F.greatest(F.lit(0), F.least(F.col("x1") + 1, F.floor(F.col("w") / 2)) - F.col("x0")).alias("lf"),
        band.alias("band"), *[inside(F.lit(k)).cast("int").alias(f"k{k}") for k in range(GRID)],
    )
    counts = [F.sum(F.when(F.col("band") == r, F.col(f"k{k}")).otherwise(0)).cast("int") for r in range(GRID) for k in range(GRID)]
    return rows.groupBy(key).agg(
        F.sum("n").cast("long").alias("area"), F.sum("up").cast("long").alias("upper"), F.sum("lf").cast("long").alias("left"),
        F.array(*counts).alias("coarse"),
    )


def iou_bound(a: Column, b: Column, area_a: Column, area_b: Column) -> Column:
    """Largest IoU that two masks with these block counts can have.

    Spelled out block by block, because that compiles to plain arithmetic.
    """
    shared = F.lit(0)
    for i in range(GRID * GRID):
        shared = shared + F.least(F.get(a, F.lit(i)), F.get(b, F.lit(i)))
    return shared / (area_a + area_b - shared)


def candidate_pairs(described: DataFrame, threshold: float, extra: Callable[[Column], Column] | None = None, key: str = "mask_id") -> DataFrame:
    """Pairs (a < b) that may reach the threshold, by counts that differ less than masks do.

    The cell counts of the mask and of its halves differ by at most the cells in which two masks
    differ, so a grid over them, with cells as wide as that bound, holds every partner in the same
    or a neighbouring cell. Inside the join the block counts give an upper bound of the IoU; only
    pairs above the threshold (and above `extra`, given that bound) leave it. The indexed side is
    salted, so a crowded grid cell is spread over tasks.
    """
    classed = described.withColumn("c", size_class(F.col("area"), threshold))
    # as the smaller (or equal) partner a mask uses its own class, as the larger one the class below
    tagged = classed.withColumn("tag", F.explode(F.array(F.col("c"), F.col("c") - 1))).withColumn("_d", largest_difference(F.col("tag"), threshold))
    placed = tagged.withColumn("u", F.floor(F.col("upper") / F.col("_d"))).withColumn("v", F.floor(F.col("left") / F.col("_d")))
    names = [c for c in described.columns if c != key]
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left = placed.select(
        F.col(key).alias("a"), F.struct("c", *names).alias("pa"), "tag", "v", F.explode(F.transform(near, lambda d: F.col("u") + d)).alias("u")
    ).select("a", "pa", "tag", "u", F.explode(F.transform(near, lambda d: F.col("v") + d)).alias("v")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    right = placed.select(
        F.col(key).alias("b"), F.struct("c", *names).alias("pb"), "tag", "u", "v", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt")
    )
    # small inputs, large work per row: a fixed number of partitions keeps them from being coalesced
    parts = work_partitions(described.sparkSession)
    keys = ["tag", "u", "v", "salt"]
    joined = left.repartition(parts, *keys).join(right.repartition(parts, *keys), keys).where((F.col("a") < F.col("b")) & (F.least("pa.c", "pb.c") == F.col("tag")))
    bound = iou_bound(F.col("pa.coarse"), F.col("pb.coarse"), F.col("pa.area"), F.col("pb.area"))
    # the bound is evaluated once per pair, as a column of the join's output
    kept = joined.select("a", "b", "pa", "pb", bound.alias("bound"))
    accepted = F.col("bound") >= threshold * (1 - 1e-12)
    return kept.where(accepted if extra is None else accepted & extra(F.col("bound"))).select("a", "b")


def similar_contents(runs: DataFrame, threshold: float, described: DataFrame | None = None, extra: Callable[[Column], Column] | None = None, key: str = "mask_id") -> DataFrame:
    """Pairs (a < b) of distinct masks with IoU >= threshold > 0, with their IoU.

    Masks must be distinct and share one frame: collapse copies first (`collapse`). `described` may
    carry further columns beside the profile for `extra` to use.
    """
    if described is None:
        described, _ = materialize(profiles(runs, key))
    candidates, _ = materialize(candidate_pairs(described, threshold, extra, key))
    return measured_pairs(candidates, runs, described.select(key, "area"), key).where(F.col("iou") >= threshold)


def measured_pairs(candidates: DataFrame, runs: DataFrame, areas: DataFrame, key: str = "mask_id") -> DataFrame:
    """Exact IoU of the given pairs (a, b); pairs without overlap have IoU 0."""
    first = candidates.join(runs.select(F.col(key).alias("a"), "y", "x0", "x1"), "a")
    second = candidates.join(runs.select(F.col(key).alias("b"), "y", "x0", "x1"), "b")
    common = intersect_runs(first, second, ["a", "b"]).groupBy("a", "b").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("inter"))
    sized = (
        candidates.join(common, ["a", "b"], "left")
        .join(areas.select(F.col(key).alias("a"), F.col("area").alias("area_a")), "a")
        .join(areas.select(F.col(key).alias("b"), F.col("area").alias("area_b")), "b")
    )
    inter = F.coalesce("inter", F.lit(0))
    return sized.select("a", "b", (inter / F.greatest(F.col("area_a") + F.col("area_b") - inter, F.lit(1))).alias("iou"))


def collapse(digests: DataFrame, key: str = "mask_id") -> DataFrame:
    """(key, content, copies): the smallest key with the same raster, and how many masks share it."""
    groups = digests.groupBy("digest").agg(F.min(key).alias("content"), F.count("*").alias("copies"))
    return digests.join(groups, "digest").select(key, "content", "copies")


def standardized_vectors(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, v): columns scaled to zero mean and unit population deviation (0 becomes 1)."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()

    def scaled(c: str) -> Column:
        return (F.col(c).cast("double") - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)

    return df.select(key, F.array(*[scaled(c) for c in columns]).alias("v"))


def neighbour_pairs(neighbours: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Unordered neighbour pairs, once each, with their target difference."""
    pairs = neighbours.select(
        F.least(key, "neighbour").alias("id_a"), F.greatest(key, "neighbour").alias("id_b"), "distance"
    ).groupBy("id_a", "id_b").agg(F.max("distance").alias("distance"))
    a = targets.select(F.col(key).alias("id_a"), F.col("target").alias("target_a"))
    b = targets.select(F.col(key).alias("id_b"), F.col("target").alias("target_b"))
    return pairs.join(a, "id_a").join(b, "id_b").withColumn("target_difference", F.abs(F.col("target_a") - F.col("target_b")))


def neighbour_summary(pairs: DataFrame) -> DataFrame:
    sums = pairs.agg(F.count("*").alias("n"), F.avg("target_difference").alias("mean_difference"))
    return attach_percentiles(sums, pairs, [], "target_difference", {"median_difference": 0.5, "p90_difference": 0.9})


def ranked_contradictions(pairs: DataFrame, top: int = 20) -> DataFrame:
    """The `top` neighbour pairs by target difference per distance."""
    ratio = F.col("target_difference") / F.greatest("distance", F.lit(1e-9))
    return pairs.withColumn("ratio", ratio).orderBy(F.desc("ratio"), "id_a", "id_b").limit(top)
