"""Run-length form of binary masks: (mask_id, h, w, y, x0, x1), both ends inclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.session import materialize

KEYS = ["mask_id", "h", "w"]
#: Runs that one task gets when whole masks are dealt out.
RUNS_PER_TASK = 50_000


def by_mask(runs: DataFrame) -> tuple[DataFrame, int]:
    """Runs stored once and dealt out by mask, with the number of parts, which grows with the runs.

    Windows and groups of a mask, or of its rows, then need no other shuffle. Left to itself, the planner joins parts of
    such shuffles up to a size on disk, and runs take many times that in memory once they are widened and sorted.
    """
    stored, n = materialize(runs.withColumn("_row", F.lit(True)), "_row")
    parts = max(runs.sparkSession.sparkContext.defaultParallelism, -(-n // RUNS_PER_TASK))
    return stored.repartition(parts, "mask_id"), parts


def cells_to_runs(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Foreground cells to maximal runs: cells of one run share x minus their rank in the row."""
    keys = keys or KEYS
    rank = F.row_number().over(Window.partitionBy(*keys, "y").orderBy("x"))
    island = cells.withColumn("_g", F.col("x") - rank)
    return (
        island.groupBy(*keys, "y", "_g")
        .agg(F.min("x").cast("int").alias("x0"), F.max("x").cast("int").alias("x1"))
        .drop("_g")
    )


def bits_to_runs(masks: DataFrame, bits: str = "bits") -> DataFrame:
    """Raster-order boolean arrays to maximal runs, inside each row: no shuffle.

    A run starts where a set cell has no set cell to its left in its image row, and ends where it
    has none to its right; both lists are in raster order, so the k-th start pairs with the k-th end.
    """
    at = F.col(bits)
    w = F.col("w")
    cells = F.sequence(F.lit(0), F.size(at) - 1)

    def on(i: Column) -> Column:
        return F.get(at, i)

    starts = F.filter(cells, lambda i: on(i) & ((i % w == 0) | ~F.coalesce(on(i - 1), F.lit(False))))
    ends = F.filter(cells, lambda i: on(i) & ((i % w == w - 1) | ~F.coalesce(on(i + 1), F.lit(False))))
    paired = masks.where(F.exists(bits, lambda b: b)).select(*KEYS, F.inline(F.arrays_zip(starts.alias("s"), ends.alias("e"))))
    return paired.select(
        *KEYS,
        F.floor(F.col("s") / w).cast("int").alias("y"),
        (F.col("s") % w).cast("int").alias("x0"),
        (F.col("e") % w).cast("int").alias("x1"),
    )


def runs_to_cells(runs: DataFrame) -> DataFrame:
    return runs.select(*[c for c in runs.columns if c not in ("x0", "x1")], F.explode(F.sequence("x0", "x1")).alias("x"))


def merge_runs(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Union of overlapping or touching intervals of each row, as maximal runs."""
    keys = keys or KEYS
    row = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("_new", (reach.isNull() | (F.col("x0") > reach + 1)).cast("int"))
    numbered = opened.withColumn("_g", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy(*keys, "y", "_g")
        .agg(F.min("x0").cast("int").alias("x0"), F.max("x1").cast("int").alias("x1"))
        .drop("_g")
    )


def intersect_runs(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cells set in both masks: equi-join on the image row, overlap as the residual condition."""
    keys = keys or KEYS
    right = b.select(*keys, "y", F.col("x0").alias("_a"), F.col("x1").alias("_b"))
    return (
        a.join(right, [*keys, "y"])
        .where((F.col("x0") <= F.col("_b")) & (F.col("_a") <= F.col("x1")))
        .select(*keys, "y", F.greatest("x0", "_a").alias("x0"), F.least("x1", "_b").alias("x1"))
    )


def complement_runs(runs: DataFrame, dims: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Background runs of every image row, rows without foreground included.

    Each image row gets a sentinel before and after its runs; the gaps between neighbours are the
    background. `dims` has one row per mask with the keys.
    """
    keys = keys or KEYS
    edge = dims.select(*keys, F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y")).withColumn("x0", F.col("w")).withColumn("x1", F.col("w"))
    both = runs.select(*keys, "y", "x0", "x1").unionByName(edge.select(*keys, "y", "x0", "x1"))
    row = Window.partitionBy(*keys, "y").orderBy("x0")
    start = F.coalesce(F.lag("x1").over(row) + 1, F.lit(0))
    return both.select(*keys, "y", start.cast("int").alias("_s"), (F.col("x0") - 1).cast("int").alias("_e")).where("_s <= _e").withColumnsRenamed({"_s": "x0", "_e": "x1"})


def digests(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """sha256 over shape and sorted runs: equal rasters of equal shape share it.

    The row digests are hashed first, so the per-mask list holds one fixed-size entry per image row.
    """
    keys = keys or KEYS
    per_row = runs.groupBy(*keys, "y").agg(
        F.sort_array(F.collect_list(F.struct("x0", "x1"))).alias("segs")
    ).withColumn(
        "line", F.concat_ws(",", F.transform("segs", lambda s: F.concat_ws("-", s["x0"].cast("string"), s["x1"].cast("string"))))
    )
    text = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("y", "line"))), lambda s: F.concat_ws(":", s["y"].cast("string"), s["line"])), ";"
    )
    return per_row.groupBy(*keys).agg(F.sha2(F.concat_ws("x", F.col("h").cast("string") if "h" in keys else F.lit(""), F.col("w").cast("string") if "w" in keys else F.lit(""), text), 256).alias("digest"))
