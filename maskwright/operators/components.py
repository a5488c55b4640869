"""Four-neighbour connected components of run tables.

Each image is cut into blocks of rows. Inside a block, whose size is bounded by the image width, the
components are found by a vectorised helper over Arrow batches of many blocks. Only the runs on block
borders then form a graph between blocks, on which minimum labels spread by hooking and pointer
jumping in joins: the number of rounds grows with the logarithm of the longest path, and images of
one block need no round at all. Every round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.session import materialize

ROW_BLOCK = 256


def node_id(y: Column, x0: Column) -> Column:
    """Raster order of a run's first cell; image rows are narrower than 2**21 pixels."""
    return F.shiftleft(y.cast("long"), 21) + x0


def minimum_labels(edges: DataFrame, keys: list[str], max_rounds: int = 64) -> DataFrame | None:
    """(keys, node, label): the smallest node reachable from each node that has an edge.

    None when there are no edges.

    `edges` holds (keys, u, v) in both directions. Per round a node takes the smallest grandparent
    among its neighbours, hands it to its own parent as well, and skips to its grandparent.
    """
    edges, n_edges = materialize(edges.select(*keys, "u", "v", F.lit(True).alias("_any")), "_any")
    if n_edges == 0:
        return None
    labels = edges.groupBy(*keys, F.col("u").alias("node")).agg(F.min("v").alias("v")).select(
        *keys, "node", F.least("node", "v").alias("parent")
    )
    for _ in range(max_rounds):
        above = labels.select(*keys, F.col("node").alias("parent"), F.col("parent").alias("grand"))
        known = labels.join(above, [*keys, "parent"])
        near = (
            edges.join(known.select(*keys, F.col("node").alias("v"), "grand"), [*keys, "v"])
            .groupBy(*keys, F.col("u").alias("node")).agg(F.min("grand").alias("near"))
        )
        offers = known.join(near, [*keys, "node"]).select(
            *keys,
            F.inline(F.array(
                F.struct(F.col("parent").alias("node"), F.col("near").alias("offer"), F.lit(None).cast("long").alias("old")),
                F.struct(F.col("node").alias("node"), F.least("near", "grand").alias("offer"), F.col("parent").alias("old")),
            )),
        )
        stepped = offers.groupBy(*keys, "node").agg(F.min("offer").alias("offer"), F.max("old").alias("old")).select(
            *keys, "node", F.least("offer", "old").alias("parent"), (F.col("offer") < F.col("old")).alias("changed")
        )
        labels, changed = materialize(stepped, "changed")
        if changed == 0:
            return labels.withColumnRenamed("parent", "label")
    raise RuntimeError(f"labels still changed after {max_rounds} rounds")


def touching_roots(group: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Index of the first run of each run's component; runs are sorted by (group, y, x0).

    Touching runs of neighbouring rows are found by binary search on (group, row, x), and the
    smallest index spreads over the pairs by hooking and pointer jumping.
    """
    width = int(x1.max()) + 2
    row = group.astype(np.int64) * (int(y.max()) + 2) + y
    starts, ends = row * width + x0, row * width + x1
    first = np.searchsorted(ends, (row + 1) * width + x0, side="left")
    stop = np.searchsorted(starts, (row + 1) * width + x1, side="right")
    count = np.maximum(stop - first, 0)
    u = np.repeat(np.arange(len(row)), count)
    v = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(u))
    parent = np.arange(len(row))
    while True:
        pu, pv = parent[u], parent[v]
        open_ = pu != pv
        if not open_.any():
            return parent
        u, v, pu, pv = u[open_], v[open_], pu[open_], pv[open_]
        low = np.minimum(pu, pv)
        np.minimum.at(parent, pu, low)
        np.minimum.at(parent, pv, low)
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def block_roots(ys: pd.Series, x0s: pd.Series, x1s: pd.Series) -> pd.Series:
    """Per block, the position of each run's component root inside the block's sorted runs."""
    sizes = np.array([len(v) for v in ys])
    begin = np.cumsum(sizes) - sizes
    group = np.repeat(np.arange(len(sizes)), sizes)
    roots = touching_roots(group, *(np.concatenate(list(c)).astype(np.int64) for c in (ys, x0s, x1s)))
    local = (roots - begin[group]).astype(np.int32)
    return pd.Series(np.split(local, np.cumsum(sizes)[:-1]))


def _rooted(runs: DataFrame, keys: list[str], row_block: int) -> DataFrame:
    """Add `root`: the first run of each run's component inside its block of rows."""
    blocks = (
        runs.withColumn("_block", F.expr(f"y div {row_block}"))
        .groupBy(*keys, "_block")
        .agg(F.sort_array(F.collect_list(F.struct("y", "x0", "x1"))).alias("r"))
        .withColumn("root", block_roots(F.col("r.y"), F.col("r.x0"), F.col("r.x1")))
    )
    placed = blocks.select(*keys, "r", F.inline(F.arrays_zip(F.col("r").alias("run"), F.col("root").alias("at"))))
    y, x0 = F.get(F.col("r"), F.col("at"))["y"], F.get(F.col("r"), F.col("at"))["x0"]
    return placed.select(
        *keys, F.col("run.y").alias("y"), F.col("run.x0").alias("x0"), F.col("run.x1").alias("x1"), node_id(y, x0).alias("root")
    )


def label_components(runs: DataFrame, keys: list[str] | None = None, row_block: int = ROW_BLOCK) -> DataFrame:
    """Runs with `component`, the first run (in raster order) of their four-neighbour component."""
    keys = keys or ["mask_id"]
    nodes, _ = materialize(_rooted(runs, keys, row_block))
    # only the last row of a block meets the first row of the next one
    upper = nodes.where(F.pmod("y", F.lit(row_block)) == row_block - 1)
    lower = nodes.where(F.pmod("y", F.lit(row_block)) == 0).select(
        *keys, (F.col("y") - 1).alias("y"), F.col("x0").alias("c"), F.col("x1").alias("e"), F.col("root").alias("_v")
    )
    touching = (
        upper.join(lower, [*keys, "y"])
        .where((F.col("x0") <= F.col("e")) & (F.col("c") <= F.col("x1")))
        .select(*keys, F.inline(F.array(
            F.struct(F.col("root").alias("u"), F.col("_v").alias("v")), F.struct(F.col("_v").alias("u"), F.col("root").alias("v")),
        )))
        .distinct()
    )
    labels = minimum_labels(touching, keys)
    if labels is None:
        return nodes.withColumnRenamed("root", "component")
    return nodes.join(labels.withColumnRenamed("node", "root"), [*keys, "root"], "left").select(
        *keys, "y", "x0", "x1", F.coalesce("label", "root").alias("component")
    )


def component_sizes(labelled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["mask_id"]
    return labelled.groupBy(*keys, "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("size"))


def component_counts(labelled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Number of components and the share of the largest one."""
    keys = keys or ["mask_id"]
    return component_sizes(labelled, keys).groupBy(*keys).agg(
        F.count("*").alias("components"), F.sum("size").alias("area"), (F.max("size") / F.sum("size")).alias("largest_fraction")
    )


def hole_cells(runs: DataFrame, dims: DataFrame) -> DataFrame:
    """Cells of background components that do not reach the frame, per mask (masks with holes only)."""
    from maskwright.operators.runs import complement_runs

    background = complement_runs(runs, dims)
    labelled = label_components(background, ["mask_id", "h", "w"])
    inner = (F.col("x0") > 0) & (F.col("x1") < F.col("w") - 1) & (F.col("y") > 0) & (F.col("y") < F.col("h") - 1)
    parts = labelled.groupBy("mask_id", "component").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("size"), F.min(inner.cast("int")).alias("enclosed")
    )
    return parts.where("enclosed = 1").groupBy("mask_id").agg(F.sum("size").alias("holes"))


def topology(labelled: DataFrame, original: str, keys: list[str] | None = None, variant: str = "variant", parts: int | None = None) -> DataFrame:
    """Does every original component map to exactly one own component of each other variant?

    `labelled` holds the original and the perturbed masks under `variant`. One row per mask and
    perturbed variant; a mask that the variant erased has zero components there. With `parts`, the overlap of runs is found
    in that many tasks, however small the runs are on disk.
    """
    keys = keys or ["mask_id"]
    first = labelled.where(F.col(variant) == original).drop(variant)
    others = labelled.where(F.col(variant) != original)
    counts = labelled.groupBy(*keys, variant).agg(F.count_distinct("component").alias("n"))
    right = others.select(*keys, "y", variant, F.col("x0").alias("c"), F.col("x1").alias("e"), F.col("component").alias("target"))
    if parts is not None:
        first, right = first.repartition(parts, *keys, "y"), right.repartition(parts, *keys, "y")
    pairs = (
        first.join(right, [*keys, "y"])
        .where((F.col("x0") <= F.col("e")) & (F.col("c") <= F.col("x1")))
        .select(*keys, variant, "component", "target").distinct()
        .groupBy(*keys, variant)
        .agg(F.count("*").alias("pairs"), F.count_distinct("component").alias("sources"), F.count_distinct("target").alias("targets"))
    )
    base = counts.where(F.col(variant) == original).select(*keys, F.col("n").alias("n_original"))
    return (
        base.join(counts.where(F.col(variant) != original).withColumnRenamed("n", "n_perturbed"), keys, "left")
        .join(pairs, [*keys, variant], "left")
        .fillna(0, ["n_perturbed", "pairs", "sources", "targets"])
        .withColumn("valid", (F.col("n_original") == F.col("n_perturbed")) & (F.col("pairs") == F.col("n_original"))
                    & (F.col("sources") == F.col("n_original")) & (F.col("targets") == F.col("n_original")))
    )
