"""Forests of all folds grown in tasks: what leaves a task is the sum of what its trees say, never a tree.

Values become bins (32 a feature, or up to 256, thresholds from the training rows of each fold), equal rows of bins become one cell, and a
task grows some trees of one fold level by level on the fold's stored table. The rows that are asked walk down while
the trees grow. So no model exists anywhere, neither on the driver nor in the tasks, and a forest costs one job whatever its
depth. Draws depend on the seed, the tree's number and the order of keys, not on tasks. The table of a fold must fit a task
(`TABLE_BYTES`); above that `planted` gives None, and the caller fits Spark's own forest, whose rows stay distributed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.session import materialize, shared_dir

#: Bins of a feature, as Spark's forests have by default, and the most a byte can tell apart.
BINS, FINE_BINS = 32, 256
#: Points that stand for the values of a feature in one task's summary, where it has more than twice as many.
POINTS = 1024
TREES_PER_TASK = 20
#: Row and tree pairs that are searched at once; a node with FEW of them tries each, TRIED at once.
ENTRIES = 1 << 16
FEW, TRIED = 16, 1 << 16
#: Memory of a task's table, about ROW_BYTES a row beside its bins.
TABLE_BYTES = 384 << 20
ROW_BYTES = 40
#: A split must lower the squared error by more than rounding does, as a share of the whole deviation.
LEAST_GAIN = 1e-10


@dataclass(frozen=True)
class Subset:
    """Places of the features a forest is fitted on; only one that is `every` answers rows that are not `own`."""

    at: tuple[int, ...]
    every: bool = True


def subset_size(strategy: str, n: int, classes: int, trees: int) -> int:
    """Features tried at a node, by Spark's names."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classes else "onethird"
    named = {"all": n, "onethird": math.ceil(n / 3), "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n)))}
    if strategy in named:
        return named[strategy]
    return min(n, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * n)


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Between which of the sorted values the bins part: all of few values, otherwise near equal counts, as Spark places them."""
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < bins:
        return middle
    stride, before, target, out = counts.sum() / bins, counts[0], counts.sum() / bins, []
    for k in range(1, len(values)):
        now = before + counts[k]
        if abs(before - target) < abs(now - target):
            out.append(middle[k - 1])
            target += stride
        before = now
    return np.array(out)


def _merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(values, return_inverse=True)
    return found, np.bincount(back, counts, len(found))


def _shortened(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most POINTS + 1 values with the counts of those around them."""
    if len(values) <= 2 * POINTS:
        return values, counts
    place = ((np.cumsum(counts) - counts / 2) * POINTS / counts.sum()).astype(int)
    last = np.flatnonzero(np.r_[place[1:] != place[:-1], True])
    return values[last], np.diff(np.r_[0.0, np.cumsum(counts)[last]])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(float, copy=False)
    if column.null_count or flat.null_count or len(x) != len(column) * width or np.isnan(x).any():
        raise ValueError("a feature was null or NaN; expected numbers")
    return x.reshape(-1, width)


def _edges(rows: DataFrame, width: int, folds: list[int], bins: int) -> tuple[dict[int, list[np.ndarray]], int]:
    """Thresholds of every feature for every fold, from the rows of the other folds, and the number of rows (fold, x)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            fold, x = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            for own in np.unique(fold):
                part = x[fold == own]
                for k in range(width):
                    values, counts = held.get((int(own), k), (np.empty(0), np.empty(0)))
                    held[int(own), k] = _shortened(*_merged(np.r_[values, part[:, k]], np.r_[counts, np.ones(len(part))]))
        lists = lambda i: pa.array([v[i] for v in held.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.int32()), pa.array([k for _, k in held], pa.int32()), lists(0), lists(1)], names=["fold", "feature", "value", "n"])

    def parted(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for fold in folds:
            own = part[part["fold"] != fold].sort_values("fold")
            if len(own):
                out.append((int(part["feature"].iloc[0]), fold, thresholds(*_merged(np.concatenate(own["value"].to_list()), np.concatenate(own["n"].to_list())), bins).tolist()))
        return pd.DataFrame(out, columns=["feature", "held", "at"])

    summary, _ = materialize(rows.select(F.col("fold").cast("int").alias("fold"), "x").mapInArrow(summed, "fold int, feature int, value array<double>, n array<double>"))
    n = summary.where("feature = 0").agg(F.sum(F.aggregate("n", F.lit(0.0), lambda a, b: a + b))).first()[0] or 0
    found = summary.groupBy("feature").applyInPandas(parted, "feature int, held int, at array<double>").collect()
    edges: dict[int, list] = {}
    for r in found:
        edges.setdefault(r["held"], [None] * width)[r["feature"]] = np.array(r["at"], float)
    return edges, int(n)


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> pa.Array:
    out = np.empty(x.shape, np.uint8)
    for k, at in enumerate(edges):
        out[:, k] = np.searchsorted(at, x[:, k])
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])


def _read(directory: str, columns: list[str]) -> pa.Table:
    """The stored table of one fold, through any store that Arrow knows."""
    if directory.startswith("file:") and not directory.startswith("file://"):
        directory = "file://" + directory.removeprefix("file:")
    store, path = pafs.FileSystem.from_uri(directory.replace("s3a://", "s3://", 1)) if "://" in directory else (pafs.LocalFileSystem(), directory)
    found = sorted(f.path for f in store.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet"))
    parts = []
    for p in found:
        with store.open_input_file(p) as file:
            parts.append(pq.ParquetFile(file).read(columns=columns))
    return pa.concat_tables(parts).combine_chunks() if parts else pa.table({c: [] for c in columns})


def _unpacked(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _distinct(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of bins, and the place of every row among them."""
    sizes = bins.max(0, initial=0).astype(int) + 1
    if np.log2(sizes).sum() < 62:
        code = np.zeros(len(bins), np.int64)
        for k, size in enumerate(sizes):
            code = code * size + bins[:, k]
    else:
        code = np.ascontiguousarray(bins).view(f"V{bins.shape[1]}").ravel()
    _, first, back = np.unique(code, return_index=True, return_inverse=True)
    return np.ascontiguousarray(bins[first]), back.ravel()


def _large(columns, cell, node, weight, value, node_weight, node_value, least, chosen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bin) of the best split of every node, by sums for each bin."""
    nodes = len(node_weight)
    every, best, feature, at = np.arange(nodes), np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, int)
    parent = sum(s * s for s in node_value) / node_weight
    for k, b in enumerate(columns):
        size = int(b.max()) + 1
        if size < 2:
            continue
        key = node * size + b[cell]
        lw = np.bincount(key, weight, nodes * size).reshape(nodes, size)[:, :-1].cumsum(1)
        rw = node_weight[:, None] - lw
        good = (lw >= least) & (rw >= least)
        if chosen is not None:
            good &= chosen[:, k, None]
        score = -parent[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            for v, s in zip(value, node_value):
                left = np.bincount(key, v, nodes * size).reshape(nodes, size)[:, :-1].cumsum(1)
                score = score + left * left / lw + (s[:, None] - left) ** 2 / rw
        score = np.where(good, score, -np.inf)
        place = score.argmax(1)
        more = np.flatnonzero(score[every, place] > best)
        best[more], feature[more], at[more] = score[more, place[more]], k, place[more]
    return best, feature, at


def _small(x, cell, first, count, weight, value, node_weight, node_value, least, chosen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of nodes with at most FEW entries, which lie together: every entry's bin is tried as the last of the left side."""
    nodes, features = len(first), x.shape[1]
    best, feature, at = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, int)
    mean = [s / node_weight for s in node_value]
    for most in (FEW // 4, FEW // 2, FEW):
        sized = np.flatnonzero((count <= most) & ((count > most // 2) | (most == FEW // 4)))
        step = max(1, TRIED // (most * features))
        for begin in range(0, len(sized), step):
            own = sized[begin : begin + step]
            rank = np.arange(most)[:, None]
            inside = rank < count[own]
            entry = first[own] + np.where(inside, rank, 0)
            b = np.ascontiguousarray(x[cell[entry]].transpose(0, 2, 1))  # entry, feature, node
            w = np.where(inside, weight[entry], 0.0).astype(np.float32)
            v = [np.where(inside, s[entry] - weight[entry] * m[own], 0.0).astype(np.float32) for s, m in zip(value, mean)]
            lw, left = np.zeros(b.shape, np.float32), [np.zeros(b.shape, np.float32) for _ in v]
            part = np.empty(b.shape, np.float32)
            for i in range(most):
                below = (b[i] <= b).astype(np.float32)
                lw += np.multiply(below, w[i], out=part)
                for total, s in zip(left, v):
                    total += np.multiply(below, s[i], out=part)
            whole = node_weight[own].astype(np.float32)
            rw = whole - lw
            good = (lw >= least) & (rw >= least)
            if chosen is not None:
                good &= chosen[own].T
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(good, sum(s * s for s in left) * (whole / (lw * rw)), -1.0).reshape(most * features, -1)
            place = score.argmax(0)
            gain = score[place, np.arange(len(own))]
            found = gain > 0
            best[own], feature[own] = gain, np.where(found, place % features, -1)
            at[own] = b.reshape(most * features, -1)[place, np.arange(len(own))]
    return best, feature, at


def grown(x: np.ndarray, weights: np.ndarray, sums: np.ndarray, asked: np.ndarray, least: float, depth: int, tried: int, scale: float, draws: list) -> np.ndarray:
    """What the trees say together of the rows of `asked`: a row for each of `sums`.

    `x` has the bins of the cells, `weights` (tree, cell) how often each was drawn, `sums` (tree, value, cell) what it adds to
    a leaf. A level of all trees is grown at once; `draws` are the trees' own generators.
    """
    columns = np.ascontiguousarray(x.T)
    tree, cell = np.nonzero(weights)
    weight, node, owner = weights[tree, cell], tree, np.arange(len(weights))
    value = [sums[tree, k, cell] for k in range(sums.shape[1])]
    row, at = np.tile(np.arange(len(asked)), len(weights)), np.repeat(owner, len(asked))
    out = np.zeros((len(value), len(asked)))
    for level in range(depth + 1):
        nodes = len(owner)
        node_weight = np.bincount(node, weight, nodes)
        node_value = [np.bincount(node, v, nodes) for v in value]
        count = np.bincount(node, minlength=nodes)
        first = np.cumsum(count) - count
        gain, feature, split_at = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, int)
        some = np.flatnonzero((node_weight >= 2 * least) & (count > 1)) if level < depth else np.empty(0, int)
        chosen = None
        if len(some) and tried < x.shape[1]:
            of = np.bincount(owner[some], minlength=len(draws))
            drawn = np.concatenate([draws[t].random((of[t], x.shape[1]), np.float32) for t in np.flatnonzero(of)])
            chosen = np.zeros(drawn.shape, bool)
            np.put_along_axis(chosen, np.argpartition(drawn, tried - 1, axis=1)[:, :tried], True, axis=1)
        few = count[some] <= FEW
        for use, small in ((few, True), (~few, False)):
            own = some[use]
            if not len(own):
                continue
            w, v, may = node_weight[own], [s[own] for s in node_value], None if chosen is None else chosen[use]
            if small:
                gain[own], feature[own], split_at[own] = _small(x, cell, first[own], count[own], weight, value, w, v, least, may)
            else:
                number = np.full(nodes, -1)
                number[own] = np.arange(len(own))
                e = np.flatnonzero(number[node] >= 0)
                gain[own], feature[own], split_at[own] = _large(columns, cell[e], number[node[e]], weight[e], [s[e] for s in value], w, v, least, may)
        inner = (feature >= 0) & (gain > LEAST_GAIN * scale * node_weight)
        leaf = ~inner[at]
        for k, s in enumerate(node_value):
            out[k] += np.bincount(row[leaf], (s / np.maximum(node_weight, 1e-300))[at[leaf]], len(asked))
        if not inner.any():
            break
        number = np.cumsum(inner) - 1
        row, at = row[~leaf], at[~leaf]
        at = 2 * number[at] + (asked[row, feature[at]] > split_at[at])
        use = np.flatnonzero(inner[node])
        node = node[use]
        node = 2 * number[node] + (x[cell[use], feature[node]] > split_at[node])
        # entries of a node lie together
        order = np.sort((node << 32) | np.arange(len(use)))
        use, node = use[order & 0xFFFFFFFF], order >> 32
        cell, weight, value = cell[use], weight[use], [v[use] for v in value]
        owner = np.repeat(owner[inner], 2)
    return out


def _forest(vec: np.ndarray, y: np.ndarray, asked: np.ndarray, own: np.ndarray, subsets: list[Subset], settings: dict, classes: int, first: int, last: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every subset: the rows of `asked` it answers, and the sums of what the trees `first` to `last` say of them."""
    cells, back = _distinct(vec)
    n, width = len(cells), max(1, classes)
    mean = 0.0 if classes else float(y.mean())
    scale = 1.0 if classes else float(((y - mean) ** 2).mean())
    views = []
    for s in subsets:
        rows = np.arange(len(asked)) if s.every else np.flatnonzero(own)
        x, place = _distinct(cells[:, s.at])
        a, answer = _distinct(asked[rows][:, s.at])
        views.append((s, rows, x, place, a, answer, np.zeros((width, len(a)))))
    step = max(1, ENTRIES // n)
    for at in range(first, last, step):
        trees = range(at, min(at + step, last))
        weights, sums = np.zeros((len(trees), n)), np.zeros((len(trees), width, n))
        for k, t in enumerate(trees):
            draw = np.random.default_rng([settings["seed"], t]).poisson(1.0, len(y)) if settings["numTrees"] > 1 else np.ones(len(y))
            weights[k] = np.bincount(back, draw, n)
            if classes:
                sums[k] = np.bincount(back * classes + y.astype(int), draw, n * classes).reshape(n, classes).T
            else:
                sums[k, 0] = np.bincount(back, draw * (y - mean), n)
        for number, (s, _, x, place, a, _, total) in enumerate(views):
            joined = lambda v: np.bincount(place, v, len(x))  # noqa: B023, E731
            tried = subset_size(settings.get("featureSubsetStrategy", "auto"), len(s.at), classes, settings["numTrees"])
            draws = [np.random.default_rng([settings["seed"], t, number]) for t in trees]
            total += grown(
                x, np.stack([joined(w) for w in weights]), np.stack([[joined(v) for v in tree] for tree in sums]), a,
                settings["minInstancesPerNode"], settings["maxDepth"], tried, scale, draws,
            )
    return [(rows, total[:, answer] + mean * (last - first)) for _, rows, _, _, _, answer, total in views]


@dataclass(frozen=True)
class Grove:
    """The binned training table of every fold, stored."""

    path: str
    edges: dict[int, list[np.ndarray]]
    width: int
    settings: dict
    classes: int

    def vectors(self, rows: DataFrame, all_folds: bool = False) -> DataFrame:
        """`rows` without `x`, with the fold `held` that answers them and their bins `vec`; in all folds, or their own."""
        edges, width = self.edges, self.width
        kept = [c for c in rows.columns if c != "x"]
        at = kept.index("fold")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fold, x = batch.column(at).to_numpy(), _matrix(batch.column(len(kept)), width)
                for held in edges:
                    use = np.arange(len(x)) if all_folds else np.flatnonzero(fold == held)
                    if len(use):
                        part = batch.take(pa.array(use))
                        yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(np.full(len(use), held), pa.int32()), _bins(x[use], edges[held])], names=[*kept, "held", "vec"])

        fields = [rows.schema[c] for c in kept]
        return rows.select(*kept, "x").mapInArrow(run, T.StructType([*fields, T.StructField("held", T.IntegerType()), T.StructField("vec", T.BinaryType())]))

    def said(self, asked: DataFrame, subsets: list[Subset] | None = None) -> DataFrame:
        """(held, subset, vec, p0, ...): the mean of what all trees of a fold say of every `vec` that is asked (held, vec, own).

        One value for a regression, a share for each class otherwise. A subset that is not `every` answers `own` rows only.
        """
        spark = asked.sparkSession
        subsets = subsets or [Subset(tuple(range(self.width)))]
        path, question, width, settings, classes = self.path, f"{self.path}/asked-{uuid.uuid4().hex}", self.width, self.settings, self.classes
        asked.groupBy("held", "vec").agg(F.max("own").alias("own")).write.partitionBy("held").parquet(question)
        trees = settings["numTrees"]
        jobs = [(held, at, min(at + TREES_PER_TASK, trees)) for at in range(0, trees, TREES_PER_TASK) for held in sorted(self.edges)]
        names = ["held", "subset", "vec", *[f"p{k}" for k in range(max(1, classes))]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for job in batch.column(0).to_pylist():
                    held, first, last = jobs[job]
                    asked = _read(f"{question}/held={held}", ["vec", "own"])
                    if not len(asked):
                        continue
                    table = _read(f"{path}/train/held={held}", ["place", "y", "vec"])
                    if not len(table):
                        raise ValueError(f"fold {held} had no training rows")
                    y = table["y"].to_numpy()
                    order = np.lexsort((y, table["place"].to_numpy()))
                    vec = _unpacked(table["vec"], width)[order]
                    del table
                    bins, own = _unpacked(asked["vec"], width), asked["own"].to_numpy()
                    for k, (rows, total) in enumerate(_forest(vec, y[order], bins, own, subsets, settings, classes, first, last)):
                        for at in range(0, len(rows), 1 << 16):
                            part = rows[at : at + (1 << 16)]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(part), held), pa.int32()), pa.array(np.full(len(part), k), pa.int32()), asked["vec"].combine_chunks().take(pa.array(part)), *[pa.array(t[at : at + (1 << 16)]) for t in total]], names=names
                            )

        schema = "held int, subset int, vec binary, " + ", ".join(f"{p} double" for p in names[3:])
        parts = spark.range(0, len(jobs), 1, max(1, len(jobs))).mapInArrow(run, schema)
        return materialize(parts.groupBy("held", "subset", "vec").agg(*[(F.sum(p) / trees).alias(p) for p in names[3:]]))[0]


def planted(rows: DataFrame, width: int, settings: dict, classes: int = 0, folds: list[int] | None = None, bins: int = BINS) -> Grove | None:
    """The stored tables of every fold's forest, from rows (fold, key, y, x); None where a task could not hold one.

    `x` is an array of `width` numbers, `y` the target, or the class from 0. A row trains the folds that are not its own. `folds`
    are those that are asked, by default all that occur; `bins` is at most FINE_BINS.
    """
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect()) if folds is None else folds
    edges, n = _edges(rows, width, folds, bins)
    if n * (width + ROW_BYTES) > TABLE_BYTES:
        return None
    path = f"{shared_dir(rows.sparkSession).rstrip('/')}/maskwright/grove-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, x = batch.column(0).to_numpy(), _matrix(batch.column(3), width)
            if batch.column(2).null_count:
                raise ValueError("a target was null; expected a number")
            for held in edges:
                use = np.flatnonzero(fold != held)
                if len(use):
                    part = batch.take(pa.array(use))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(use), held), pa.int32()), part.column(1), part.column(2), _bins(x[use], edges[held])], names=["held", "place", "y", "vec"])

    table = rows.select(F.col("fold").cast("int").alias("fold"), F.xxhash64("key").alias("place"), F.col("y").cast("double").alias("y"), "x")
    table.mapInArrow(run, "held int, place long, y double, vec binary").write.partitionBy("held").parquet(f"{path}/train")
    # a fold without training rows is asked too, and is an error there
    return Grove(path, {f: edges.get(f, [np.empty(0)] * width) for f in folds}, width, settings, classes)


def numbers(features: list[str]) -> Column:
    """The columns as one array of numbers."""
    return F.array(*[F.col(c).cast("double") for c in features])


def held_out(rows: DataFrame, features: list[str], target: str, settings: dict, key: str, classes: int = 0, all_folds: bool = False) -> DataFrame | None:
    """`rows` with `held` and what the forest of that fold says (p0, ...): once in their own fold, or in every fold; None where no task could hold a fold."""
    own = rows.withColumn("fold", F.col("fold").cast("int")).withColumn("x", numbers(features))
    grove = planted(own.select("fold", F.col(key).alias("key"), F.col(target).alias("y"), "x"), len(features), settings, classes)
    if grove is None:
        return None
    asked, _ = materialize(grove.vectors(own, all_folds))
    said = grove.said(asked.select("held", "vec", F.lit(True).alias("own")))
    return asked.join(said.drop("subset"), ["held", "vec"]).drop("vec")
