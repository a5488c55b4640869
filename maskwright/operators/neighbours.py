"""Exact nearest neighbours by pivots and the triangle inequality, and the principal components they may stand on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.session import materialize, work_partitions

#: Points of a block; a cell with more is cut into several. Probes that meet a region at once. Most pivots (each a vector). Most blocks of a region.
BLOCK, PROBES, MOST_PIVOTS, REGION = 1024, 16384, 2048, 32


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of `x` to all rows of `y`, to about the seventh digit of the rows' lengths."""
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)))


def _nearest(v: np.ndarray, u: np.ndarray, others: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distance, id) of the row of `u` nearest to each row of `v`; equal distances (to 9 digits) give the smallest id.

    `own` are the ids of `v`, which are no neighbours of themselves. One product finds who is close enough; only those are
    measured by differences.
    """
    best, who = np.full(len(v), np.inf), np.full(len(v), np.iinfo(np.int64).max)
    squares = (u * u).sum(1)
    for at in range(0, len(v), 512):
        x = v[at : at + 512]
        rough = (x * x).sum(1)[:, None] + squares[None, :] - 2 * (x @ u.T)
        if own is not None:
            rough[own[at : at + 512][:, None] == others[None, :]] = np.inf
        low = rough.min(1, initial=np.inf)
        row, column = np.nonzero(rough <= np.where(np.isfinite(low), low, -1.0)[:, None] * (1 + 1e-9) + 1e-6)
        d = np.sqrt(((x[row] - u[column]) ** 2).sum(1))
        order = np.lexsort((others[column], np.round(d, 9), row))
        first = order[np.flatnonzero(np.append(True, row[order][1:] != row[order][:-1]))] if len(row) else order
        best[at + row[first]], who[at + row[first]] = d[first], others[column[first]]
    return best, who


def _region_size(blocks: int, cores: int) -> int:
    """Blocks of a region: as many as leave four pairs of regions for each core, up to REGION."""
    return max(1, min(REGION, int(blocks / (2 * np.sqrt(cores)))))


def nearest_neighbours(vectors: DataFrame, key: str) -> DataFrame:
    """(key, neighbour, distance): the exact nearest other row of every row of `vectors` (key, v), ties to the smallest key.

    Equal vectors collapse first; a repeated one is its own copy's neighbour at distance 0. Every point belongs to the nearest
    of a bounded number of pivots. A search inside a block of its own cell bounds its distance; then it visits only the blocks
    that may hold something closer: not those behind the plane between two pivots, nor outside the ring that a
    block's points fill around their pivot. A point goes once to each region of neighbouring blocks that holds such a
    block, where the bound is tried again block by block. Regions and the probes that meet them are bounded, so a crowded
    cell is many small tasks. A single row has no neighbour and is not in the result.
    """
    spark = vectors.sparkSession
    groups, _ = materialize(vectors.groupBy("v").agg(F.min(key).alias("id"), F.count("*").alias("copies")))
    keyed = vectors.join(groups.where("copies > 1"), "v")
    second = keyed.where(F.col(key) != F.col("id")).groupBy("id").agg(F.min(key).alias("next"))
    repeated = keyed.join(second, "id").select(
        key, F.when(F.col(key) == F.col("id"), F.col("next")).otherwise(F.col("id")).alias("neighbour"), F.lit(0.0).alias("distance")
    )
    n = groups.count()
    if n < 2:
        return repeated
    pivots = np.array([r["v"] for r in groups.orderBy(F.xxhash64("id"), "id").limit(min(MOST_PIVOTS, max(1, round(n / BLOCK)))).collect()], float)
    apart = _distances(pivots, pivots)
    sent = spark.sparkContext.broadcast((pivots, apart))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, _ = sent.value
        for batch in batches:
            if batch.num_rows:
                d, cell = _nearest(_matrix(batch.column(1)), pivots, np.arange(len(pivots)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(d)], names=["id", "v", "copies", "cell", "ring"])

    points, _ = materialize(groups.select("id", "v", "copies").mapInArrow(placed, "id long, v array<double>, copies long, cell long, ring double"))
    sizes = points.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    points, _ = materialize(points.join(F.broadcast(sizes), "cell").withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)")).drop("blocks"))
    # one row for each block of BLOCK points
    rings = sorted(points.groupBy("cell", "block").agg(F.min("ring").alias("inner"), F.max("ring").alias("outer")).collect())
    table = spark.sparkContext.broadcast(tuple(np.array([r[c] for r in rings]) for c in ("cell", "inner", "outer")))
    size = _region_size(len(rings), spark.sparkContext.defaultParallelism)
    numbered = spark.createDataFrame([(r["cell"], r["block"], k, k // size) for k, r in enumerate(rings)], "cell long, block int, at int, region int")
    points = points.join(F.broadcast(numbered), ["cell", "block"])

    def inside(rows: pa.Table) -> pa.Table:
        v, ids = _matrix(rows["v"]), rows["id"].to_numpy()
        best, who = _nearest(v, v, ids, ids)
        return pa.table({"id": rows["id"], "v": rows["v"], "copies": rows["copies"], "at": rows["at"], "ub": pa.array(best), "other": pa.array(who)})

    parts = work_partitions(spark)
    first, _ = materialize(points.repartition(parts, "cell", "block").groupBy("cell", "block").applyInArrow(inside, "id long, v array<double>, copies long, at int, ub double, other long"))

    def may_hold(v: np.ndarray, ub: np.ndarray, at: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Whether a block (column) may hold something closer than `ub` to a row of `v`, whose own block is `at`."""
        pivots, apart = sent.value
        cells, inner, outer = (x[blocks] for x in table.value)
        home, ub = table.value[0][at], ub[:, None] * (1 + 1e-9) + 1e-9
        used, back = np.unique(cells, return_inverse=True)
        d, gap = _distances(v, pivots[used])[:, back], apart[home][:, cells]
        mine = np.sqrt(((v - pivots[home]) ** 2).sum(1))[:, None]
        plane = np.where(gap > 1e-6, (d**2 - mine**2) / np.where(gap > 1e-6, 2 * gap, 1), 0.0)
        slack = 1e-6 * (1 + d + np.sqrt((v * v).sum(1))[:, None])  # products round; a visit too many does no harm
        return (plane <= ub + slack) & (d - outer <= ub + slack) & (inner - d <= ub + slack) & (blocks[None, :] != at[:, None])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(table.value[0]))
        starts = every[::size]
        for batch in batches:
            for from_ in range(0, batch.num_rows, 256):
                own = batch.slice(from_, 256)
                open_ = may_hold(_matrix(own.column(1)), own.column(3).to_numpy(), own.column(2).to_numpy(), every)
                row, region = np.nonzero(np.logical_or.reduceat(open_, starts, axis=1))
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(k).take(pa.array(row)) for k in range(4)], pa.array(region.astype(np.int32))], names=["id", "v", "at", "ub", "region"]
                )

    single = first.where("copies = 1")
    probes, _ = materialize(single.select("id", "v", "at", "ub").mapInArrow(visits, "id long, v array<double>, at int, ub double, region int"))
    shares = probes.groupBy("region").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("shares"))
    cut = probes.join(F.broadcast(shares), "region").withColumn("share", F.expr("cast(pmod(xxhash64(id), shares) as int)"))
    met = points.join(F.broadcast(shares), "region").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        v, ub, at = _matrix(left["v"]), left["ub"].to_numpy().copy(), left["at"].to_numpy()
        u, ids, block = _matrix(right["v"]), right["id"].to_numpy(), right["at"].to_numpy()
        best, who = np.full(len(v), np.inf), np.full(len(v), np.iinfo(np.int64).max)
        for b in np.unique(block):
            rows = np.flatnonzero(may_hold(v, ub, at, np.array([b]))[:, 0])
            d, other = _nearest(v[rows], u[block == b], ids[block == b])
            r, old = np.round(d, 9), np.round(best[rows], 9)
            nearer = (r < old) | ((r == old) & (other < who[rows]))
            rows, d, other = rows[nearer], d[nearer], other[nearer]
            best[rows], who[rows], ub[rows] = d, other, np.minimum(ub[rows], d)
        found = np.isfinite(best)
        return pa.table({"id": left["id"].filter(pa.array(found)), "other": pa.array(who[found]), "d": pa.array(best[found])})

    tile = ["region", "share"]
    across = (
        cut.select(*tile, "id", "v", "at", "ub").repartition(parts, *tile).groupBy(*tile)
        .cogroup(met.select(*tile, "id", "v", "at").repartition(parts, *tile).groupBy(*tile)).applyInArrow(compare, "id long, other long, d double")
    )
    found = single.where("ub < double('inf')").select("id", "other", F.col("ub").alias("d")).unionByName(across)
    best = found.groupBy("id").agg(F.min(F.struct(F.round("d", 9).alias("r"), "other", "d")).alias("b"))
    return repeated.unionByName(best.select(F.col("id").alias(key), F.col("b.other").alias("neighbour"), F.col("b.d").alias("distance")))


@dataclass(frozen=True)
class Components:
    """Directions of largest variance of packed rasters, their variances, and the sum of all variances."""

    mean: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    total: float


#: Rasters that are unpacked at once; cells whose sums travel together.
RASTERS, CELLS = 256, 512


def _cells(column: pa.Array) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1), axis=1).astype(float)


def _products(rows: DataFrame, bases: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For every fold, the sum over the rasters x outside it of x (x . basis)', a row for each cell; tasks add up their rows and hand on one matrix a fold."""
    folds = list(bases)
    cells, width = bases[folds[0]].shape
    sent = rows.sparkSession.sparkContext.broadcast(np.concatenate([bases[f] for f in folds], 1))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((cells, width * len(folds)))
        for batch in batches:
            for at in range(0, batch.num_rows, RASTERS):
                own = batch.slice(at, RASTERS)
                x, fold = _cells(own.column(0)), own.column(1).to_numpy()
                y = x @ sent.value
                for k, f in enumerate(folds):
                    y[fold == f, k * width : (k + 1) * width] = 0.0
                total += x.T @ y
        places = [(f, at, total[at : at + CELLS, k * width : (k + 1) * width].tobytes()) for k, f in enumerate(folds) for at in range(0, cells, CELLS)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*places), (pa.int32(), pa.int32(), pa.binary()))], names=["fold", "at", "part"])

    def added(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p) for p in parts["part"].to_pylist())
        return pa.table({"fold": parts["fold"][:1], "at": parts["at"][:1], "part": pa.array([total.tobytes()], pa.binary())})

    schema = "fold int, at int, part binary"
    summed = rows.select("bits", F.col("fold").cast("int").alias("fold")).mapInArrow(partial, schema).groupBy("fold", "at").applyInArrow(added, schema)
    out = {f: np.zeros((cells, width)) for f in folds}
    for r in summed.toArrow().to_pylist():
        out[r["fold"]][r["at"] : r["at"] + CELLS] = np.frombuffer(r["part"]).reshape(-1, width)
    return out


def fold_components(rows: DataFrame, folds: list[int], k: int, cells: int, oversample: int = 10, passes: int = 6, seed: int = 42) -> dict[int, Components]:
    """For every fold, the first `k` components of the packed rasters (`bits`, `fold`) outside it, by a randomised range finder with power passes.

    The covariance (cells * cells numbers) never exists: a pass over all rasters adds up its product with k + oversample directions
    for all folds at once, so what comes to the driver has cells * (k + oversample) numbers a fold, whatever the number of
    rasters. The sign of a direction makes its largest entry positive. Fewer than two rasters have no variance.
    """
    width = min(cells, k + oversample)
    counts, sums = _sums(rows, cells)
    nothing = Components(np.zeros(cells), np.eye(cells)[:, :k], np.zeros(k), 0.0)
    n = {f: sum(c for g, c in counts.items() if g != f) for f in folds}
    some = [f for f in folds if n[f]]
    if not some:
        return {f: nothing for f in folds}
    mean = {f: sum(v for g, v in sums.items() if g != f) / n[f] for f in some}
    basis = {f: np.random.default_rng(seed).standard_normal((cells, width)) for f in some}

    def spread(q: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        made = _products(rows, q)
        return {f: made[f] / n[f] - np.outer(mean[f], mean[f] @ q[f]) for f in some}

    for _ in range(passes):
        basis = {f: np.linalg.qr(m)[0] for f, m in spread(basis).items()}
    out = {f: nothing for f in folds}
    for f, made in spread(basis).items():
        values, rotation = np.linalg.eigh((basis[f].T @ made + made.T @ basis[f]) / 2)
        order = np.argsort(-values)[:k]
        directions = basis[f] @ rotation[:, order]
        top = np.abs(directions).argmax(0)
        directions = directions * np.where(directions[top, np.arange(directions.shape[1])] < 0, -1.0, 1.0)
        out[f] = Components(mean[f], directions, np.maximum(values[order], 0.0), float((mean[f] * (1 - mean[f])).sum()))
    return out


def principal_components(rows: DataFrame, k: int, cells: int, oversample: int = 10, passes: int = 6, seed: int = 42) -> Components:
    """The same of all rasters (`bits`)."""
    return fold_components(rows.select("bits", F.lit(0).alias("fold")), [1], k, cells, oversample, passes, seed)[1]


def _sums(rows: DataFrame, cells: int) -> tuple[dict[int, int], dict[int, np.ndarray]]:
    """For every fold, the number of rasters, and how many of them have each cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, RASTERS):
                own = batch.slice(at, RASTERS)
                x, fold = _cells(own.column(0)), own.column(1).to_numpy()
                for f in np.unique(fold):
                    # the number of rasters after the cells
                    total[int(f)] = total.get(int(f), 0.0) + np.append(x[fold == f].sum(0), (fold == f).sum())
        for f, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(cells + 1, f), pa.int32()), pa.array(np.arange(cells + 1), pa.int32()), pa.array(t)], names=["fold", "cell", "n"])

    table = rows.select("bits", F.col("fold").cast("int").alias("fold")).mapInArrow(partial, "fold int, cell int, n double").groupBy("fold", "cell").agg(F.sum("n").alias("n")).orderBy("fold", "cell").toArrow()
    fold, n = table["fold"].to_numpy(), table["n"].to_numpy()
    return {int(f): int(n[fold == f][-1]) for f in np.unique(fold)}, {int(f): n[fold == f][:-1] for f in np.unique(fold)}


def projected(rows: DataFrame, components: Components, key: str, name: str) -> DataFrame:
    """(key, name): the coordinates of every raster along the components, as an array."""
    sent = rows.sparkSession.sparkContext.broadcast((components.mean, components.directions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, directions = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own = batch.slice(at, 512)
                y = (_cells(own.column(1)) - mean) @ directions
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([own.column(0), flat], names=[key, name])

    return rows.select(key, "bits").mapInArrow(run, f"{key} long, {name} array<double>")


def full_representation(features: DataFrame, columns: list[str], raw: DataFrame, canonical: DataFrame, key: str = "mask_id", raw_parts: int = 24, canonical_parts: int = 16, cells: int = 96 * 96) -> DataFrame:
    """(key, v): features beside the components of two rasters (key, bits) of each mask, every column in units of its deviation."""
    own = features.select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias("own"))
    parts = own
    for name, rows, k in (("raw", raw, raw_parts), ("canonical", canonical, canonical_parts)):
        parts = parts.join(projected(rows, principal_components(rows, k, cells), key, name), key)
    joined, _ = materialize(parts.select(key, F.concat("own", "raw", "canonical").alias("v")))
    return standardized(joined, len(columns) + raw_parts + canonical_parts, key)


def standardized(rows: DataFrame, width: int, key: str) -> DataFrame:
    """`rows` (key, v) with every coordinate at mean 0 and population deviation 1 (0 becomes 1)."""
    stats = rows.agg(*[f(F.get("v", F.lit(i))).alias(f"{n}{i}") for i in range(width) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return rows.select(key, F.array(*[(F.get("v", F.lit(i)) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0) for i in range(width)]).alias("v"))
