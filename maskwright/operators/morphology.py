"""Perturbations of run tables: expansion, contraction, rescaling, shifts; quality and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import half_even, half_up
from maskwright.operators.components import label_components, topology
from maskwright.operators.runs import KEYS, by_mask, merge_runs

LONG_SIDE = 1024
DISK_RADIUS = 5
# The perturbations and their order in the public tables.
SHIFTS = {"shift_up": (-1, 0), "shift_down": (1, 0), "shift_left": (0, -1), "shift_right": (0, 1)}


def disk_radius(canonical_radius: int, long_side: int) -> Column:
    """Radius on the mask's own grid: ties up, at least one."""
    return F.greatest(half_up(F.lit(float(canonical_radius)) * F.greatest("h", "w") / F.lit(float(long_side))), F.lit(1)).cast("int")


def disk_rows(radius: Column) -> Column:
    """Array of (dy, half): half width of a Euclidean disk in each of its rows."""
    return F.transform(F.sequence(-radius, radius), lambda dy: F.struct(
        dy.alias("dy"), F.floor(F.sqrt((radius * radius - dy * dy).cast("double"))).cast("int").alias("half")))


def diamond_rows(steps: int) -> Column:
    """Array of (dy, half) of the cross element applied `steps` times."""
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(steps - abs(dy)).alias("half")) for dy in range(-steps, steps + 1)])


def expand(runs: DataFrame, element: Column, keys: list[str] | None = None) -> DataFrame:
    """Dilation: every run widened in each row of the element, clipped to the frame and merged."""
    keys = keys or KEYS
    spread = runs.select(*keys, "y", "x0", "x1", F.inline(element))
    moved = spread.select(
        *keys, (F.col("y") + F.col("dy")).cast("int").alias("y"),
        F.greatest(F.col("x0") - F.col("half"), F.lit(0)).alias("x0"),
        F.least(F.col("x1") + F.col("half"), F.col("w") - 1).alias("x1"),
    ).where((F.col("y") >= 0) & (F.col("y") < F.col("h")))
    return merge_runs(moved, keys)


def contract(runs: DataFrame, element: Column, keys: list[str] | None = None) -> DataFrame:
    """Erosion, outside counted as background: cells that every row of the element covers.

    Shrunk runs open and close coverage along the row; a running sum finds the stretches that all
    element rows cover. Equal positions are added up before the shuffle.
    """
    keys = keys or KEYS
    spread = runs.select(*keys, "y", "x0", "x1", F.size(element).alias("need"), F.inline(element))
    shrunk = spread.select(
        *keys, "need", (F.col("y") - F.col("dy")).cast("int").alias("y"),
        (F.col("x0") + F.col("half")).alias("a"), (F.col("x1") - F.col("half") + 1).alias("b"),
    ).where("a < b")
    events = shrunk.select(*keys, "need", "y", F.inline(F.array(
        F.struct(F.col("a").alias("x"), F.lit(1).alias("step")), F.struct(F.col("b").alias("x"), F.lit(-1).alias("step")),
    ))).groupBy(*keys, "need", "y", "x").agg(F.sum("step").alias("step"))
    row = Window.partitionBy(*keys, "need", "y").orderBy("x")
    swept = events.withColumn("cover", F.sum("step").over(row.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.lead("x").over(row) - 1)
    return swept.where("cover = need").select(*keys, "y", F.col("x").cast("int").alias("x0"), F.col("end").cast("int").alias("x1"))


def rescale(runs: DataFrame, factor: float, keys: list[str] | None = None) -> DataFrame:
    """Grow or shrink about the centre of mass by inverse nearest mapping, ties to even.

    The mapping is separable and monotone, so a source run maps to one destination run in each
    destination row that looks up its row. Closed bounds of the inverse mapping, for any factor, hold the
    candidates, which are tested exactly.
    """
    keys = keys or KEYS
    whole = Window.partitionBy(*keys)
    n = (F.col("x1") - F.col("x0") + 1).cast("double")
    total = F.sum(n).over(whole)
    placed = runs.withColumn("_cx", F.sum(n * (F.col("x0") + F.col("x1")) / 2).over(whole) / total).withColumn(
        "_cy", F.sum(n * F.col("y")).over(whole) / total
    )
    s = F.lit(float(factor))

    def source(at: Column, centre: Column) -> Column:
        return half_even(centre + (at.cast("double") - centre) / s)

    def between(low: Column, high: Column, centre: Column) -> Column:
        """Destinations whose source may lie in [low, high], one more at either end."""
        start = F.floor(centre + (low - centre) * s).cast("int") - 1
        return F.sequence(start, F.greatest(start, F.ceil(centre + (high - centre) * s).cast("int") + 1))

    cx, cy = F.col("_cx"), F.col("_cy")
    rows = F.filter(between(F.col("y") - 0.5, F.col("y") + 0.5, cy), lambda d: (source(d, cy) == F.col("y")) & (d >= 0) & (d < F.col("h")))
    first = F.array_min(F.filter(between(F.col("x0") - 0.5, F.col("x0") - 0.5, cx), lambda d: source(d, cx) >= F.col("x0")))
    last = F.array_max(F.filter(between(F.col("x1") + 0.5, F.col("x1") + 0.5, cx), lambda d: source(d, cx) <= F.col("x1")))
    moved = placed.select(
        *keys, F.explode(rows).alias("y"), F.greatest(first, F.lit(0)).alias("x0"), F.least(last, F.col("w") - 1).alias("x1")
    ).where("x0 <= x1")
    return merge_runs(moved, keys)


def shift_distance(fraction: float = 0.05) -> Column:
    """Pixels of a shift: the fraction of the long side, ties up, at least one."""
    return F.greatest(half_up(F.greatest("h", "w") * F.lit(fraction)), F.lit(1)).cast("int")


def shift(runs: DataFrame, dy: Column, dx: Column, keys: list[str] | None = None) -> DataFrame:
    """Shifted and clipped runs with `cuts`: whether any foreground of the mask leaves the frame."""
    keys = keys or KEYS
    y, a, b = F.col("y") + dy, F.col("x0") + dx, F.col("x1") + dx
    leaves = (y < 0) | (y >= F.col("h")) | (a < 0) | (b >= F.col("w"))
    moved = runs.withColumn("cuts", F.max(leaves).over(Window.partitionBy(*keys)))
    return moved.select(
        *keys, "cuts", y.cast("int").alias("y"), F.greatest(a, F.lit(0)).cast("int").alias("x0"), F.least(b, F.col("w") - 1).cast("int").alias("x1")
    ).where((F.col("y") >= 0) & (F.col("y") < F.col("h")) & (F.col("x0") <= F.col("x1")))


def shift_cuts(runs: DataFrame, fraction: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """One row per mask and direction: the distance and whether the shift would cut foreground."""
    keys = keys or KEYS
    box = runs.groupBy(*keys).agg(F.min("x0").alias("l"), F.max("x1").alias("r"), F.min("y").alias("t"), F.max("y").alias("b"))
    d = shift_distance(fraction)
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("perturbation"), d.alias("distance"),
            ((F.col("t") + sy * d < 0) | (F.col("b") + sy * d >= F.col("h")) | (F.col("l") + sx * d < 0) | (F.col("r") + sx * d >= F.col("w"))).alias("cuts"),
        )
        for name, (sy, sx) in SHIFTS.items()
    ])
    return box.select(*keys, F.inline(rows))


def touches_border(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or KEYS
    edge = (F.col("x0") == 0) | (F.col("x1") == F.col("w") - 1) | (F.col("y") == 0) | (F.col("y") == F.col("h") - 1)
    return runs.groupBy(*keys).agg(F.max(edge).alias("touches"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))


def quality(runs: DataFrame, dims: DataFrame) -> DataFrame:
    """Size, foreground share, border contact, components, largest share and hole ratio per mask."""
    from maskwright.operators.components import component_counts, hole_cells

    basic = touches_border(runs)
    parts = component_counts(label_components(runs)).drop("area")
    holes = hole_cells(runs, dims)
    return (
        basic.join(parts, "mask_id").join(holes, "mask_id", "left")
        .select(
            "mask_id", "w", "h", (F.col("area") / (F.col("h") * F.col("w"))).alias("foreground_ratio"),
            F.col("components").alias("component_count"), "largest_fraction",
            (F.coalesce("holes", F.lit(0)) / F.col("area")).alias("hole_ratio"), F.col("touches").cast("int").alias("touches_border"),
        )
    )


def morphology_variants(runs: DataFrame, long_side: int = LONG_SIDE) -> DataFrame:
    """Original, expansion and contraction by the disk of each mask, tagged by `variant`."""
    element = disk_rows(disk_radius(DISK_RADIUS, long_side))
    return (
        runs.select(*KEYS, "y", "x0", "x1", F.lit("original").alias("variant"))
        .unionByName(expand(runs, element).withColumn("variant", F.lit("expansion")))
        .unionByName(contract(runs, element).withColumn("variant", F.lit("contraction")))
    )


def topology_of(variants: DataFrame, parts: int | None = None) -> DataFrame:
    """Topology verdict of both morphological variants of each mask (one column each)."""
    labelled = label_components(variants, ["mask_id", "variant"])
    # both verdicts must exist even if contraction erased the mask completely
    found = topology(labelled, "original", parts=parts)
    return found.groupBy("mask_id").agg(
        F.coalesce(F.bool_and(F.when(F.col("variant") == "expansion", F.col("valid"))), F.lit(False)).alias("expansion_valid"),
        F.coalesce(F.bool_and(F.when(F.col("variant") == "contraction", F.col("valid"))), F.lit(False)).alias("contraction_valid"),
    )


def eligibility(runs: DataFrame, dims: DataFrame, long_side: int = LONG_SIDE) -> DataFrame:
    """Paired eligibility for expansion and contraction, with the first reason that applies.

    A mask without foreground has no border contact and no components, so it is eligible.
    """
    return eligibility_of(*by_mask(morphology_variants(by_mask(runs)[0], long_side)), dims)


def eligibility_of(variants: DataFrame, parts: int, dims: DataFrame) -> DataFrame:
    """Eligibility from morphological variants that `by_mask` has dealt out in `parts`."""
    reaches = touches_border(variants.where("variant = 'expansion'")).select("mask_id", F.col("touches").alias("at_border"))
    verdict = topology_of(variants, parts)
    joined = dims.select("mask_id").join(reaches, "mask_id", "left").join(verdict, "mask_id", "left")
    reason = (
        F.when(F.col("at_border"), "insufficient_expansion_margin")
        .when(~F.col("expansion_valid"), "expansion_topology_violation")
        .when(~F.col("contraction_valid"), "contraction_topology_violation")
        .otherwise("")
    )
    return joined.select("mask_id", F.when(reason == "", "eligible").otherwise("rejected").alias("status"), reason.alias("reason"))


def perturbed(runs: DataFrame, variants: DataFrame) -> DataFrame:
    """All eight perturbations of every mask in one run table, tagged by `perturbation`.

    Shifts that would cut foreground are left out; morphological variants are given for all masks.
    """
    d = shift_distance()
    parts = {
        "scale_shrink": rescale(runs, 0.95), "scale_grow": rescale(runs, 1.05),
        **{name: shift(runs, sy * d, sx * d).where(~F.col("cuts")).drop("cuts") for name, (sy, sx) in SHIFTS.items()},
    }
    out = variants.where("variant != 'original'").select(*KEYS, "y", "x0", "x1", F.col("variant").alias("perturbation"))
    for name, part in parts.items():
        out = out.unionByName(part.select(*KEYS, "y", "x0", "x1", F.lit(name).alias("perturbation")))
    return out


def scenarios(runs: DataFrame) -> DataFrame:
    """Older scenario set: original, one or two steps of erosion and dilation, shift by four."""
    runs, _ = by_mask(runs.select(*KEYS, "y", "x0", "x1"))
    parts = {
        "original": runs.select(*KEYS, "y", "x0", "x1"),
        "erosion_1": contract(runs, diamond_rows(1)), "erosion_2": contract(runs, diamond_rows(2)),
        "dilation_1": expand(runs, diamond_rows(1)), "dilation_2": expand(runs, diamond_rows(2)),
        "shift_4": shift(runs, F.lit(0), F.lit(4)).drop("cuts"),
    }
    out = None
    for name, part in parts.items():
        tagged = part.select(*KEYS, "y", "x0", "x1", F.lit(name).alias("scenario"))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def augment(runs: DataFrame, seed: int, epoch: int, fraction: float = 0.05, flip_probability: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """Seeded flip and frame-safe shift of every mask; no foreground is ever lost.

    Draws come from sha256 of (seed, epoch, mask, purpose), so they do not depend on partitioning.
    """
    keys = keys or KEYS
    whole = Window.partitionBy(*keys)

    def draw(purpose: str) -> Column:
        text = F.concat_ws(":", F.lit(f"{seed}:{epoch}:{purpose}"), F.col("mask_id").cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")

    flip = draw("flip") < F.lit(int(flip_probability * 2**32))
    flipped = runs.select(
        *keys, "y", F.when(flip, F.col("w") - 1 - F.col("x1")).otherwise(F.col("x0")).alias("x0"),
        F.when(flip, F.col("w") - 1 - F.col("x0")).otherwise(F.col("x1")).alias("x1"),
    )

    def pick(name: str, low: Column, high: Column, size: Column) -> Column:
        limit = F.floor(size * F.lit(fraction))
        a, b = F.greatest(-limit, -low), F.least(limit, size - 1 - high)
        return (a + F.pmod(draw(name), b - a + 1)).cast("int")

    dy = pick("dy", F.min("y").over(whole), F.max("y").over(whole), F.col("h"))
    dx = pick("dx", F.min("x0").over(whole), F.max("x1").over(whole), F.col("w"))
    moved = flipped.withColumn("dy", dy).withColumn("dx", dx)
    return moved.select(*keys, (F.col("y") + F.col("dy")).alias("y"), (F.col("x0") + F.col("dx")).alias("x0"), (F.col("x1") + F.col("dx")).alias("x1"))
