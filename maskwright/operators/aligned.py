"""Similarity of aligned masks: canonical rasters as packed bits, compared tile by tile.

Every mask is turned upright, cropped and letterboxed once, in a kernel over Arrow batches of whole masks; what goes on
is one row with side * side bits. Masks in order of area form blocks, and a tile compares two blocks by one matrix product.
Bounds from the blocks' areas and targets say which tiles can matter, so no pair of masks ever is a row before it counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from maskwright.operators.pose import resize
from maskwright.operators.runs import KEYS
from maskwright.operators.similarity import collapse
from maskwright.operators.split import global_position
from maskwright.session import materialize, work_partitions

SIDE = 64
#: Frames larger than this are letterboxed to it before they are turned.
WORKING = 256
#: Masks of a block; a tile holds two blocks unpacked to bytes. Most blocks on a side of the square of tiles that one group holds, packed.
BLOCK, SQUARE = 1024, 8


def upright(raster: np.ndarray) -> np.ndarray:
    """The mask turned so that its principal axis is horizontal, cropped to its cells.

    Every cell of the turned frame looks up its nearest source cell. The angle follows from integer sums, so it is
    the same wherever it is computed.
    """
    ys, xs = np.nonzero(raster)
    a = len(xs)
    if a == 0:
        return np.zeros((0, 0), bool)
    sx, sy = int(xs.sum()), int(ys.sum())
    xx, yy, xy = a * int((xs * xs).sum()) - sx * sx, a * int((ys * ys).sum()) - sy * sy, a * int((xs * ys).sum()) - sx * sy
    t = 0.5 * np.arctan2(2.0 * xy, float(xx - yy)) if a > 1 else 0.0
    t = t - np.pi if t >= np.pi / 2 else t
    c, s, cx, cy = np.cos(t), np.sin(t), sx / a, sy / a
    px, py = np.array([xs.min(), xs.max()] * 2) - cx, np.repeat([ys.min(), ys.max()], 2) - cy
    u = np.arange(np.floor((px * c + py * s).min()) - 1, np.ceil((px * c + py * s).max()) + 2)[None, :]
    v = np.arange(np.floor((py * c - px * s).min()) - 1, np.ceil((py * c - px * s).max()) + 2)[:, None]
    x, y = np.floor(cx + u * c - v * s + 0.5).astype(int), np.floor(cy + u * s + v * c + 0.5).astype(int)
    inside = (x >= 0) & (x < raster.shape[1]) & (y >= 0) & (y < raster.shape[0])
    turned = inside & raster[np.where(inside, y, 0), np.where(inside, x, 0)]
    rows, columns = np.flatnonzero(turned.any(1)), np.flatnonzero(turned.any(0))
    if not len(rows):
        return np.zeros((0, 0), bool)
    return turned[rows[0] : rows[-1] + 1, columns[0] : columns[-1] + 1]


def letterboxed(mask: np.ndarray, side: int) -> np.ndarray:
    """Nearest-neighbour resize into the middle of a side x side frame."""
    out = np.zeros((side, side), bool)
    if mask.size:
        h, w = mask.shape
        factor = min(side / w, side / h)
        hh, ww = (max(1, round(n * factor)) for n in (h, w))
        rows, columns = (2 * np.arange(hh) + 1) * h // (2 * hh), (2 * np.arange(ww) + 1) * w // (2 * ww)
        top, left = (side - hh) // 2, (side - ww) // 2
        out[top : top + hh, left : left + ww] = mask[np.ix_(rows, columns)]
    return out


def canonical_bits(runs: DataFrame, side: int = SIDE, working: int = WORKING) -> DataFrame:
    """(mask_id, bits, area): the aligned raster of every mask, packed row by row, and its cells.

    Frames above `working` are letterboxed to it first, so a mask in the kernel is bounded. Runs of a mask come together
    in one shuffle; they are its rows, never its pixels.
    """
    large = F.greatest("h", "w") > working
    sized = runs.where(~large).select(*KEYS, "y", "x0", "x1").unionByName(resize(runs.where(large), working).select(*KEYS, "y", "x0", "x1"))
    return packed(sized, side, lambda raster: letterboxed(upright(raster), side))


def packed(runs: DataFrame, side: int, made: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(mask_id, bits, area): side x side rasters packed row by row, of the masks themselves or of what `made` makes of them."""
    whole = runs.groupBy(*KEYS).agg(F.collect_list(F.struct("y", "x0", "x1")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, area = [], []
            for h, w, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                edge = np.zeros((h, w + 1), np.int32)
                y, x0, x1 = (own.values.field(k).to_numpy() for k in range(3))
                np.add.at(edge, (y, x0), 1)
                np.add.at(edge, (y, x1 + 1), -1)
                raster = np.cumsum(edge, axis=1)[:, :w] > 0
                raster = made(raster) if made else raster
                bits.append(np.packbits(raster).tobytes())
                area.append(int(raster.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary()), pa.array(area, pa.int64())], names=["mask_id", "bits", "area"])

    return whole.mapInArrow(run, "mask_id long, bits binary, area long")


def bits_to_runs(bits: DataFrame, side: int = SIDE) -> DataFrame:
    """(mask_id, h, w, y, x0, x1): packed rasters as run tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raster = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, side * side // 8), axis=1).reshape(-1, side, side)
            edge = np.diff(np.pad(raster, ((0, 0), (0, 0), (1, 1))).astype(np.int8), axis=2)
            k, y, x0 = np.nonzero(edge == 1)
            x1 = np.nonzero(edge == -1)[2] - 1
            frame = np.full(len(k), side, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(k)), pa.array(frame), pa.array(frame), *[pa.array(x.astype(np.int32)) for x in (y, x0, x1)]], names=["mask_id", "h", "w", "y", "x0", "x1"]
            )

    return bits.select("mask_id", "bits").mapInArrow(run, "mask_id long, h int, w int, y int, x0 int, x1 int")


def _blocks(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """`rows` with a `block` number in the given order, stored, and one row for each block with the ranges of area and target."""
    stored, n = materialize(rows.withColumn("_one", F.lit(True)), "_one")
    placed, _ = materialize(global_position(stored, order, n).withColumn("block", F.expr(f"cast(position div {BLOCK} as int)")).drop("position"))
    ranges = [f(c).alias(f"{name}_{c}") for c in ("area", *(["target"] if "target" in rows.columns else [])) for name, f in (("low", F.min), ("high", F.max))]
    return placed, placed.groupBy("block").agg(*ranges)


def _block_pairs(table: DataFrame) -> DataFrame:
    """(i, j, a, b) for all i <= j: block numbers and their rows; as many as blocks to the square, without any mask."""
    a = table.select(F.struct(*table.columns).alias("a"))
    whole = table.agg(F.sort_array(F.collect_list(F.struct(*table.columns))).alias("all"))
    pairs = a.join(F.broadcast(whole)).select("a", F.explode("all").alias("b"))
    return pairs.where(F.col("b.block") >= F.col("a.block")).select(F.col("a.block").alias("i"), F.col("b.block").alias("j"), "a", "b")


def _square(blocks: int, cores: int) -> int:
    """Blocks on a side of a square of tiles: as many as leave four squares for each core, up to SQUARE."""
    return max(1, min(SQUARE, int(blocks / np.sqrt(8 * cores))))


def _squares(placed: DataFrame, tiles: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Masks and tiles by squares of neighbouring tiles (`p`, `q`): a mask goes once to each square that its block is part of.

    There are about as many partitions as squares, so what a task holds does not grow with the masks.
    """
    spark = placed.sparkSession
    side = _square(blocks, spark.sparkContext.defaultParallelism)
    tiles, _ = materialize(tiles.select(F.expr(f"i div {side}").alias("p"), F.expr(f"j div {side}").alias("q"), "i", "j"))
    parts = max(work_partitions(spark), tiles.select("p", "q").distinct().count())
    sides = tiles.select("p", "q", F.explode(F.array("i", "j")).alias("block")).distinct()
    return placed.join(F.broadcast(sides), "block").repartition(parts, "p", "q"), tiles.select(F.col("p").alias("tp"), F.col("q").alias("tq"), "i", "j").repartition(parts, "tp", "tq")


def _measured(placed: DataFrame, tiles: DataFrame, blocks: int, measure: Callable[[pa.Table, int, int], pa.Table], schema: str) -> DataFrame:
    """What `measure` makes of each tile (i, j), given the masks of its two blocks."""

    def run(masks: pa.Table, wanted: pa.Table) -> pa.Table:
        block, made = masks["block"].to_numpy(), []
        for i, j in zip(wanted["i"].to_pylist(), wanted["j"].to_pylist()):
            made.append(measure(masks.take(pa.array(np.flatnonzero((block == i) | (block == j)))), i, j))
        return pa.concat_tables(made)

    masks, wanted = _squares(placed, tiles, blocks)
    return masks.groupBy("p", "q").cogroup(wanted.groupBy("tp", "tq")).applyInArrow(run, schema)


def _shared(table: pa.Table, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of block i, rows of block j, common cells, IoU) of a tile; pairs of a block with itself count once, above the diagonal."""
    block, area = table["block"].to_numpy(), table["area"].to_numpy().astype(float)
    cells = np.unpackbits(np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(len(table), -1), axis=1).astype(np.float32)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    common = cells[left] @ cells[right].T
    iou = common / np.maximum(area[left][:, None] + area[right][None, :] - common, 1)
    if i == j:
        iou[np.tril_indices(len(left))] = -1.0
    return left, right, common, iou


def _ratio() -> Column:
    """Largest IoU that masks of the blocks `a` and `b` can have, by their areas."""
    gap = F.try_divide(F.least("a.high_area", "b.high_area"), F.greatest("a.low_area", "b.low_area"))
    return F.least(F.coalesce(gap, F.lit(0.0)), F.lit(1.0))


def similar(contents: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b, iou) of different rasters (mask_id, bits, area) with IoU >= threshold, and the largest IoU of all pairs as one row (iou).

    Tiles whose areas allow the threshold are measured, and hand on their pairs and their best pair. Where no pair
    reaches the threshold, the tiles that allow more than the best found so far are measured once more, and no others.
    """
    placed, table = _blocks(contents.select("mask_id", "bits", "area"), ["area", "mask_id"])
    pairs, _ = materialize(_block_pairs(table).select("i", "j", _ratio().alias("most")))
    blocks = table.count()

    def measure(table: pa.Table, i: int, j: int) -> pa.Table:
        left, right, _, iou = _shared(table, i, j)
        ids = table["mask_id"].to_numpy()
        x, y = np.nonzero(iou >= threshold)
        best = float(iou.max(initial=-1.0))
        a, b = ids[left[x]], ids[right[y]]
        last = np.arange(len(a) + 1) == len(a)  # the tile's best has no pair beside it
        return pa.table({
            "a": pa.array(np.append(np.minimum(a, b), 0), mask=last), "b": pa.array(np.append(np.maximum(a, b), 0), mask=last), "iou": pa.array(np.append(iou[x, y].astype(float), best)),
        })

    tiles = pairs.where(F.col("most") >= threshold)
    found, _ = materialize(_measured(placed, tiles, blocks, measure, "a long, b long, iou double"))
    best = found.agg(F.max("iou").alias("iou")).first()["iou"]
    best = -1.0 if best is None else best
    largest = found.agg(F.max("iou").alias("iou"))
    if best < threshold:
        rest = _measured(placed, pairs.where((F.col("most") < threshold) & (F.col("most") > best)), blocks, measure, "a long, b long, iou double")
        largest = found.unionByName(rest).agg(F.max("iou").alias("iou"))
    return found.where("a IS NOT NULL"), largest.select(F.greatest(F.coalesce("iou", F.lit(0.0)), F.lit(0.0)).alias("iou"))


def integrity(digests: DataFrame, aligned: DataFrame, features: DataFrame, key: str = "mask_id", threshold: float = 0.95) -> DataFrame:
    """(test, value): duplicate names, rasters (`digests`) and feature vectors, near-duplicate pairs and the largest IoU of `aligned` masks.

    Copies of one aligned raster count as n*(n-1)/2 pairs of IoU 1 and are never paired as rows. Without masks all values are 0.
    """
    spark = digests.sparkSession
    raw = digests.agg(F.count("*").alias("n"), F.count_distinct(key).alias("names"), F.count_distinct("digest").alias("contents")).first()
    members, _ = materialize(collapse(aligned.select(key, F.sha2("bits", 256).alias("digest")), key))
    contents = members.where(F.col(key) == F.col("content")).select(key, "copies")
    copied = contents.agg(F.coalesce(F.sum(F.expr("copies * (copies - 1) div 2")), F.lit(0)).alias("p")).first()["p"]
    found, largest = similar(aligned.join(contents.select(key), key, "left_semi"), threshold)
    weights = [contents.select(F.col(key).alias(c), F.col("copies").alias(f"k{c}")) for c in "ab"]
    near = found.join(weights[0], "a").join(weights[1], "b").agg(F.coalesce(F.sum(F.col("ka") * F.col("kb")), F.lit(0)).alias("p")).first()["p"]
    rows = [
        ("duplicate_names", float(raw["n"] - raw["names"])), ("duplicate_masks", float(raw["names"] - raw["contents"])),
        ("duplicate_feature_vectors", float(features.count() - features.drop(key).distinct().count())), ("near_duplicate_pairs", float(copied + near)),
        ("maximum_iou", 1.0 if copied else float(largest.first()["iou"])),
    ]
    return spark.createDataFrame(rows, "test string, value double")


def contradictions(aligned: DataFrame, targets: DataFrame, top: int = 20, key: str = "mask_id") -> DataFrame:
    """(id_a, id_b, target_difference, iou, score): the `top` pairs by IoU times target difference; ties give the later keys first.

    A threshold algorithm over tiles: blocks are formed by target and, within its classes, by area. A tile cannot score more
    than its largest target difference times its largest IoU. As many tiles of the highest bounds as there are cores
    are measured first; their `top`-th score leaves only the tiles that may still exceed it (or tie with it).
    """
    spark = aligned.sparkSession
    rows = aligned.join(targets.select(key, F.col("target").cast("double").alias("target")), key)
    n = rows.count()
    # as many classes of targets as a class has blocks of areas
    classes = max(1, int(np.sqrt(n / BLOCK)))
    ranked = global_position(rows.select(key, "target"), ["target", key], n).select(key, F.least(F.expr(f"position * {classes} div {max(n, 1)}"), F.lit(classes - 1)).cast("int").alias("class"))
    placed, table = _blocks(rows.join(ranked, key).select(F.col(key).alias("mask_id"), "bits", "area", "target", "class"), ["class", "area", "mask_id"])
    difference = F.greatest(F.col("a.high_target") - F.col("b.low_target"), F.col("b.high_target") - F.col("a.low_target"))
    pairs, _ = materialize(_block_pairs(table).select("i", "j", (difference * _ratio()).alias("most")))
    blocks = table.count()

    def measure(table: pa.Table, i: int, j: int) -> pa.Table:
        left, right, _, iou = _shared(table, i, j)
        ids, target = table["mask_id"].to_numpy(), table["target"].to_numpy()
        apart = np.abs(target[left][:, None] - target[right][None, :])
        score = np.where(iou >= 0, apart * iou, -1.0)
        kept = np.flatnonzero(score.ravel() >= 0)
        if len(kept) > top:
            cut = np.partition(score.ravel()[kept], len(kept) - top)[len(kept) - top]
            kept = kept[score.ravel()[kept] >= cut]
        x, y = np.unravel_index(kept, score.shape)
        a, b = np.minimum(ids[left[x]], ids[right[y]]), np.maximum(ids[left[x]], ids[right[y]])
        order = np.lexsort((-b, -a, -score[x, y]))[:top]
        return pa.table({
            "id_a": pa.array(a[order]), "id_b": pa.array(b[order]), "target_difference": pa.array(apart[x, y][order].astype(float)),
            "iou": pa.array(iou[x, y][order].astype(float)), "score": pa.array(score[x, y][order].astype(float)),
        })

    schema = "id_a long, id_b long, target_difference double, iou double, score double"
    ordered = [F.desc("score"), F.desc("id_a"), F.desc("id_b")]
    first = pairs.orderBy(F.desc("most"), "i", "j").limit(spark.sparkContext.defaultParallelism)
    first, _ = materialize(first)
    begun, _ = materialize(_measured(placed, first, blocks, measure, schema))
    best = begun.orderBy(*ordered).limit(top).collect()
    floor = best[-1]["score"] if len(best) == top else -1.0
    rest = pairs.join(F.broadcast(first.select("i", "j")), ["i", "j"], "left_anti").where(F.col("most") >= floor * (1 - 1e-9))
    return begun.unionByName(_measured(placed, rest, blocks, measure, schema)).orderBy(*ordered).limit(top)
