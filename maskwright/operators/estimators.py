"""Feature evidence through any fitted estimator: isolated, removal and permutation experiments.

A runner fits a model on training rows and hands back something that predicts a matrix. Models are fitted once for
every fold and set of features; permutations are scored by the fold's full model, never refitted. All models of an
experiment travel together to the tasks, where whole batches are scored and only error sums leave.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from maskwright.operators import evidence, grove, models
from maskwright.session import materialize, shared_dir

#: Bytes of models that tasks are sent at once; above, rows are scored by the estimator's own transform.
MODEL_BYTES = 128 << 20
#: Models fitted at the same time; tree and row pairs that are walked at once.
FITS_AT_ONCE = 8
WALKED = 1 << 20
NODE_BYTES = 28


class Fitted(Protocol):
    """A model in the tasks."""

    nbytes: int

    def predict(self, x: np.ndarray) -> np.ndarray: ...


class Runner(Protocol):
    """Fits training rows (`features` as columns, `target`); returns a model for tasks, and its transform of rows with a `features` vector."""

    def fit(self, rows: DataFrame, features: list[str], target: str) -> tuple[Fitted | None, Callable[[DataFrame], DataFrame]]: ...


@dataclass(frozen=True)
class Line:
    weights: np.ndarray
    intercept: float

    @property
    def nbytes(self) -> int:
        return self.weights.nbytes

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercept


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees in flat arrays; a leaf points at itself."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.root, self.feature, self.threshold, self.left, self.right, self.value, self.weight))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        step = max(1, WALKED // len(self.root))
        for at in range(0, len(x), step):
            rows = x[at : at + step]
            node = np.repeat(self.root[:, None], len(rows), axis=1)
            column = np.arange(len(rows))[None, :]
            while True:
                down = np.where(rows[column, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
                if (down == node).all():
                    break
                node = down
            out[at : at + step] = self.weight @ self.value[node]
        return out


def trees_of(model, spark, limit: int = MODEL_BYTES) -> Trees | None:
    """The nodes of a tree ensemble of Spark ML, through its stored form; None above `limit` bytes."""
    path = f"{shared_dir(spark).rstrip('/')}/maskwright/model-{uuid.uuid4().hex}"
    model.write().save(path)
    n = "nodeData"
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), f"{n}.id", f"{n}.prediction", f"{n}.leftChild", f"{n}.rightChild",
        f"{n}.split.featureIndex", F.try_element_at(f"{n}.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"), f"{n}.split.numCategories",
    )
    most = limit // NODE_BYTES
    table = nodes.limit(most + 1).toPandas().sort_values(["tree", "id"])
    if len(table) > most or (table["numCategories"] > 0).any():
        return None
    size = table.groupby("tree")["id"].size()
    start = table["tree"].map(size.cumsum() - size).to_numpy()
    leaf = (table["leftChild"] < 0).to_numpy()
    own = np.arange(len(table))
    child = lambda c: np.where(leaf, own, start + table[c].to_numpy()).astype(np.int32)
    weights = np.array(model.treeWeights, float)
    return Trees(
        (size.cumsum() - size).to_numpy(np.int32), np.where(leaf, 0, table["featureIndex"]).astype(np.int32), np.where(leaf, 0.0, table["threshold"].fillna(0.0)),
        child("leftChild"), child("rightChild"), table["prediction"].to_numpy(float), weights,
    )


@dataclass(frozen=True)
class MlRunner:
    """Any Spark ML regressor with a `predicted` column. Linear models and tree ensembles score in the tasks, others by their transform."""

    make: Callable[[str], Estimator]

    def fit(self, rows: DataFrame, features: list[str], target: str):
        model = self.make(target).fit(models.assemble(rows, features))
        if hasattr(model, "coefficients"):
            return Line(np.array(model.coefficients.toArray()), float(model.intercept)), model.transform
        if hasattr(model, "treeWeights"):
            found = trees_of(model, rows.sparkSession)
            if found is not None and model.__class__.__name__.startswith("RandomForest"):
                found = Trees(found.root, found.feature, found.threshold, found.left, found.right, found.value, found.weight / found.weight.sum())
            return found, model.transform
        return None, model.transform


def linear_runner() -> MlRunner:
    return MlRunner(lambda target: LinearRegression(featuresCol="features", labelCol=target, predictionCol="predicted", solver="normal"))


@dataclass(frozen=True)
class ForestRunner(MlRunner):
    """Forests of a recipe. For evidence they are grown in tasks, all sets of features of a fold side by side on the same draws."""

    settings: dict


def forest_runner(recipe: dict | None = None) -> ForestRunner:
    return ForestRunner(lambda target: models.forest(recipe, target), {**models.FOREST, **(recipe or {})})


def _forest_sums(split: DataFrame, moved: DataFrame | None, features: list[str], wanted: list[tuple[str, str, list[str]]], name: str, runner: ForestRunner, target: str, key: str) -> tuple[DataFrame, DataFrame | None] | None:
    """The error sums of all models of a forest on the held-out rows and on the permuted ones; None where no task could hold a fold."""
    spark, fold = split.sparkSession, F.col("fold").cast("int").alias("fold")
    own = split.select(fold, F.col(target).alias("y"), grove.numbers(features).alias("x"), F.col(key).alias("key"))
    planted = grove.planted(own, len(features), runner.settings)
    if planted is None:
        return None
    base, _ = materialize(planted.vectors(own.drop("key")))
    asked = base.select("held", "vec", F.lit(True).alias("own"))
    if moved is not None:
        given = F.array(*[F.when(F.col("feature") == f, F.col("given")).otherwise(F.col(f)).cast("double") for f in features])
        placed, _ = materialize(planted.vectors(moved.select(fold, F.col(target).alias("y"), "feature", "repetition", given.alias("x"))))
        asked = asked.unionByName(placed.select("held", "vec", F.lit(False).alias("own")))
    said = planted.said(asked, [grove.Subset(tuple(features.index(f) for f in kept), experiment == "full") for experiment, _, kept in wanted])
    sums = (F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("p0") - F.col("y"))).alias("error"))
    names = spark.createDataFrame([(k, experiment, label) for k, (experiment, label, _) in enumerate(wanted)], "subset int, experiment string, label string")
    fixed = base.join(said, ["held", "vec"]).groupBy("subset", F.col("held").alias("fold")).agg(*sums).join(F.broadcast(names), "subset")
    fixed = fixed.select("n", "error", "experiment", F.lit(name).alias("baseline"), "label", "fold")
    if moved is None:
        return fixed, None
    full = said.where(F.col("subset") == next(k for k, w in enumerate(wanted) if w[0] == "full"))
    out = placed.join(full, ["held", "vec"]).groupBy("repetition", F.col("feature").alias("target"), F.col("held").alias("fold")).agg(*sums)
    return fixed, out.select("repetition", "target", "n", "error", F.lit(name).alias("baseline"), "fold")


@dataclass(frozen=True)
class Trained:
    """A model of one fold: what it was fitted for, and the places of its features."""

    experiment: str
    baseline: str
    target: str
    fold: int
    at: list[int]
    fitted: Fitted | None
    transform: Callable[[DataFrame], DataFrame]


def fit_all(split: DataFrame, features: list[str], wanted: list[tuple[str, str, list[str]]], runners: dict[str, Runner], target: str = "target") -> list[Trained]:
    """Models of all training folds for every runner and (experiment, target, kept features)."""
    jobs = [(fold, name, *w) for fold in models.fold_list(split) for name in runners for w in wanted]

    def one(job) -> Trained:
        fold, name, experiment, label, kept = job
        fitted, transform = runners[name].fit(split.where(F.col("fold") != fold), kept, target)
        return Trained(experiment, name, label, fold, [features.index(f) for f in kept], fitted, transform)

    with ThreadPool(FITS_AT_ONCE) as pool:
        return pool.map(inheritable_thread_target(split.sparkSession)(one), jobs, chunksize=1)


SUMS = "model int, repetition int, target string, n long, error double"


def _error_sums(rows: DataFrame, features: list[str], trained: list[Trained], target: str, permuted: bool) -> DataFrame:
    """(model, repetition, target, n, error) of `rows` scored by the models of their fold.

    With `permuted`, a row has the `feature` whose value `given` replaces, and its `repetition`.
    """
    numbered = list(enumerate(trained))
    small = [(k, t) for k, t in numbered if t.fitted is not None]
    if sum(t.fitted.nbytes for _, t in small) > MODEL_BYTES:
        small = []
    large = [(k, t) for k, t in numbered if k not in {i for i, _ in small}]
    out = None
    if small:
        sent = rows.sparkSession.sparkContext.broadcast([(k, t.fold, t.at, t.fitted) for k, t in small])

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[tuple, list] = {}
            for batch in batches:
                x, y, fold = batch[features].to_numpy(float), batch[target].to_numpy(float), batch["fold"].to_numpy()
                if permuted:
                    x[np.arange(len(x)), [features.index(f) for f in batch["feature"]]] = batch["given"].to_numpy(float)
                for k, own, at, fitted in sent.value:
                    here = np.flatnonzero(fold == own)
                    if not len(here):
                        continue
                    error = pd.Series(np.abs(fitted.predict(x[here][:, at]) - y[here]))
                    groups = [batch[c].iloc[here].reset_index(drop=True) for c in ("repetition", "feature")] if permuted else [pd.Series(np.zeros(len(here), int)), pd.Series([""] * len(here))]
                    for key, part in error.groupby(groups):
                        total = sums.setdefault((k, *key), [0, 0.0])
                        total[0] += len(part)
                        total[1] += float(part.sum())
            yield pd.DataFrame([(*key, *v) for key, v in sums.items()], columns=[f.split()[0] for f in SUMS.split(", ")])

        columns = ["fold", target, *features, *(["feature", "given", "repetition"] if permuted else [])]
        out = rows.select(*columns).mapInPandas(partial, SUMS)
    for k, t in large:
        value = {f: F.when(F.col("feature") == f, F.col("given")).otherwise(F.col(f)) if permuted else F.col(f) for f in features}
        vector = array_to_vector(F.array(*[value[features[i]].cast("double") for i in t.at])).alias("features")
        extra = [F.col("repetition"), F.col("feature").alias("_f")] if permuted else [F.lit(0).alias("repetition"), F.lit("").alias("_f")]
        scored = t.transform(rows.where(F.col("fold") == t.fold).select(F.col(target).alias("_y"), *extra, vector))
        part = scored.groupBy(F.lit(k).alias("model"), "repetition", F.col("_f").alias("target")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("predicted") - F.col("_y"))).alias("error"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("model", "repetition", "target").agg(F.sum("n").alias("n"), F.sum("error").alias("error"))


def estimator_evidence(
    split: DataFrame, features: list[str], groups: dict[str, tuple[str, ...]], runners: dict[str, Runner], repetitions: int = 10, split_seed: int = 42,
    n: int | None = None, experiments: tuple[str, ...] = ("isolated", "removal", "permutation"), target: str = "target", key: str = "sample_id",
) -> DataFrame:
    """The evidence table of any runners: every feature alone, removed (alone and in groups), and permuted in the held-out fold.

    `split` has `fold`, `target`, the key and the features, none of them null; store it beforehand. An unknown experiment is an
    error. No features or no rows give no evidence.
    """
    unknown = sorted(set(experiments) - {"isolated", "removal", "permutation"})
    if unknown:
        raise ValueError(f"experiments were {unknown!r}; expected isolated, removal or permutation")
    n = split.count() if n is None else n
    spark = split.sparkSession
    none = spark.createDataFrame([], "experiment string, baseline string, target string, fold int, repetition int, n long, error double, reference double")
    if n == 0 or not features:
        return evidence.evidence_rows(none, split_seed)
    wanted = [v for v in evidence.variants(features, groups) if v[0] == "full" or v[0] in experiments]
    rows = None
    if "permutation" in experiments:
        rows = evidence.permuted_values(split.select(key, "fold", target, *features), features, repetitions, split_seed, n, max(1, len(models.fold_list(split))), key)
    sums = {name: _forest_sums(split, rows, features, wanted, name, r, target, key) for name, r in runners.items() if isinstance(r, ForestRunner)}
    parts = [v for v in sums.values() if v is not None]
    others = {name: r for name, r in runners.items() if sums.get(name) is None}
    trained = fit_all(split, features, wanted, others, target) if others else []
    if trained:
        names = spark.createDataFrame(
            [(k, t.experiment, t.baseline, t.target, t.fold) for k, t in enumerate(trained)], "model int, experiment string, baseline string, label string, fold int"
        )
        fitted = _error_sums(split, features, trained, target, False).drop("target", "repetition").join(F.broadcast(names), "model").drop("model")
        parts.append((fitted, None))
    fixed, _ = materialize(reduce(DataFrame.unionByName, [p for p, _ in parts]))
    reference = fixed.where("experiment = 'full'").select("baseline", "fold", F.col("error").alias("reference"))
    out = fixed.where("experiment != 'full'").join(F.broadcast(reference), ["baseline", "fold"]).select(
        "experiment", "baseline", F.col("label").alias("target"), "fold", F.lit(None).cast("int").alias("repetition"), "n", "error",
        F.when(F.col("experiment") != "isolated", F.col("reference")).alias("reference"),
    )
    if "permutation" in experiments:
        errors = [m for _, m in parts if m is not None]
        full = [t for t in trained if t.experiment == "full"]
        if full:
            own = spark.createDataFrame([(k, t.baseline, t.fold) for k, t in enumerate(full)], "model int, baseline string, fold int")
            errors.append(_error_sums(rows, features, full, target, True).join(F.broadcast(own), "model").drop("model"))
        moved = reduce(DataFrame.unionByName, errors).join(F.broadcast(reference), ["baseline", "fold"])
        out = out.unionByName(moved.select(F.lit("permutation").alias("experiment"), "baseline", "target", "fold", "repetition", "n", "error", "reference"))
    return evidence.evidence_rows(out, split_seed)
