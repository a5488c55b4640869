"""Feature evidence from linear baselines: isolated, removal and permutation experiments.

One pass adds up the Gram matrix of each fold. Every model of every training fold (full, without one
feature, without a group, one feature alone) is then a small solve on p*p numbers on the driver, and
scoring sends nothing but error sums through the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import effect_class, permutation_seed
from maskwright.operators.ranks import column_means, gram
from maskwright.operators.split import hash_order, position_in_group, prefix_digits

# The linear baselines as shrinkage of the diagonal.
BASELINES = {"ordinary": 0.0, "ridge": 0.1}
KEY = ["experiment", "baseline", "target", "scope", "fold", "repetition"]


@dataclass(frozen=True)
class LinearModel:
    """Coefficients over all features (zero where a feature is left out)."""

    experiment: str
    baseline: str
    target: str
    fold: int
    weights: tuple[float, ...]
    intercept: float


def variants(features: list[str], groups: dict[str, tuple[str, ...]]) -> list[tuple[str, str, list[str]]]:
    """(experiment, target, kept features); a removal that would empty the set is skipped."""
    out = [("full", "", list(features))]
    out += [("isolated", f, [f]) for f in features]
    removals = [(f, (f,)) for f in features] + list(groups.items())
    for target, removed in removals:
        kept = [f for f in features if f not in removed]
        if kept:
            out.append(("removal", target, kept))
    return out


def fold_systems(split: DataFrame, features: list[str], target: str = "target") -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(fold, covariances, means) of features and target over the rows outside each fold, from one Gram pass."""
    columns = [*features, target]
    centre = column_means(split, columns)
    rows = gram(split.withColumn("_one", F.lit(1.0)), [*columns, "_one"], [*centre, 0.0], "fold").collect()
    size = len(columns) + 1
    by_fold: dict[int, np.ndarray] = {}
    for r in rows:
        g = by_fold.setdefault(r["part"], np.zeros((size, size)))
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
    total = sum(by_fold.values())
    out = []
    for fold, own in sorted(by_fold.items()):
        g = total - own
        n, sums = g[-1, -1], g[-1, :-1]
        out.append((fold, g[:-1, :-1] - np.outer(sums, sums) / n, sums / n + np.array(centre)))
    return out


def _solved(cov: np.ndarray, mean: np.ndarray, at: list[int], shrink: float) -> tuple[np.ndarray, float]:
    """Weights over all features (zero outside `at`) and intercept; the diagonal grows by `shrink`."""
    weights = np.zeros(len(mean) - 1)
    a = cov[np.ix_(at, at)] * (1 + shrink * np.eye(len(at)))
    # features of very different size are solved for in units of their deviations
    unit = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    weights[at] = np.linalg.lstsq(a / np.outer(unit, unit), cov[at, -1] / unit, rcond=None)[0] / unit
    return weights, float(mean[-1] - weights @ mean[:-1])


def fold_models(split: DataFrame, features: list[str], shrink: float = 0.0, target: str = "target") -> DataFrame:
    """(fold, weights, intercept): the linear model on all features of each training fold, a table of one row per fold."""
    rows = [(fold, *_solved(cov, mean, list(range(len(features))), shrink)) for fold, cov, mean in fold_systems(split, features, target)]
    return split.sparkSession.createDataFrame([(f, w.tolist(), b) for f, w, b in rows], "fold int, weights array<double>, intercept double")


def fit_models(split: DataFrame, features: list[str], groups: dict[str, tuple[str, ...]], baselines: dict[str, float], target: str = "target") -> list[LinearModel]:
    """All linear models of all training folds from one Gram pass."""
    models = []
    for fold, cov, mean in fold_systems(split, features, target):
        for name, shrink in baselines.items():
            for experiment, label, kept in variants(features, groups):
                weights, intercept = _solved(cov, mean, [features.index(f) for f in kept], shrink)
                models.append(LinearModel(experiment, name, label, fold, tuple(float(v) for v in weights), intercept))
    return models


SUMS = T.StructType([
    T.StructField("model", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("error", T.DoubleType()), T.StructField("reference", T.DoubleType()),
])


def fitted_sums(split: DataFrame, features: list[str], models: list[LinearModel], target: str = "target") -> DataFrame:
    """Absolute-error sums of the isolated and removal models on their held-out folds.

    A batch scores all models of its folds with one matrix product and hands on one row per model.
    """
    scored = [m for m in models if m.experiment != "full"]
    full = {(m.baseline, m.fold): m for m in models if m.experiment == "full"}

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(scored), 3))
        for batch in batches:
            folds = batch["fold"].to_numpy()
            for fold in np.unique(folds):
                rows = folds == fold
                at = [k for k, m in enumerate(scored) if m.fold == fold]
                x, y = batch.loc[rows, features].to_numpy(dtype=np.float64), batch.loc[rows, target].to_numpy()
                weights = np.array([scored[k].weights for k in at]).T
                errors = np.abs(x @ weights + [scored[k].intercept for k in at] - y[:, None]).sum(axis=0)
                base = {
                    b: float(np.abs(x @ np.array(m.weights) + m.intercept - y).sum()) for (b, f), m in full.items() if f == fold
                }
                for column, k in enumerate(at):
                    totals[k] += (len(y), errors[column], base[scored[k].baseline])
        used = [k for k in range(len(scored)) if totals[k, 0] > 0]
        yield pd.DataFrame({
            "model": np.array(used, dtype=np.int32), "n": totals[used, 0].astype(np.int64), "error": totals[used, 1], "reference": totals[used, 2],
        })

    sums = split.select("fold", target, *features).mapInPandas(partial, SUMS).groupBy("model").agg(
        F.sum("n").alias("n"), F.sum("error").alias("error"), F.sum("reference").alias("reference")
    )
    names = split.sparkSession.createDataFrame(
        [(k, m.experiment, m.baseline, m.target, m.fold) for k, m in enumerate(scored)],
        "model int, experiment string, baseline string, target string, fold int",
    )
    keyed = sums.join(F.broadcast(names), "model")
    return keyed.select(
        "experiment", "baseline", "target", "fold", F.lit(None).cast("int").alias("repetition"), "n", "error",
        F.when(F.col("experiment") != "isolated", F.col("reference")).alias("reference"),
    )


def permuted_values(split: DataFrame, features: list[str], repetitions: int, split_seed: int, n: int, folds: int = 5, key: str = "sample_id", rows_per_task: int = 2_000_000) -> DataFrame:
    """Held-out rows with each feature shuffled inside the fold, for every repetition.

    The row at place p of a fixed order receives the value of the row at place p of the order by
    sha256('seed:key'), seeds derived per (fold, feature, repetition).
    """
    digits = prefix_digits(n / folds, rows_per_task)
    receivers = position_in_group(split.withColumn("_h", hash_order(0, key)), ["fold"], "_h", key, digits, "place").drop("_h")
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("given")) for f in features])
    donors = (
        split.select(key, "fold", F.inline(entries))
        .withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
        .withColumn("seed", permutation_seed(split_seed, F.col("fold"), F.col("feature"), F.col("repetition")))
        .withColumn("_h", hash_order(F.col("seed"), key))
    )
    placed = position_in_group(donors, ["fold", "feature", "repetition"], "_h", key, digits, "place")
    # sizes estimated from stored files are far below those of the rows, so neither side may be broadcast
    return receivers.hint("merge").join(placed.select("fold", "place", "feature", "repetition", "seed", "given"), ["fold", "place"])


def permutation_sums(split: DataFrame, features: list[str], models: list[LinearModel], repetitions: int, split_seed: int, n: int, target: str = "target", key: str = "sample_id") -> DataFrame:
    """Error sums with one feature shuffled and the full model kept."""
    full = [m for m in models if m.experiment == "full"]
    rows = [(m.baseline, m.fold, f, m.weights[k], list(m.weights), m.intercept) for m in full for k, f in enumerate(features)]
    coefficients = split.sparkSession.createDataFrame(rows, "baseline string, fold int, feature string, slope double, weights array<double>, intercept double")
    joined = permuted_values(split, features, repetitions, split_seed, n, key=key).join(F.broadcast(coefficients), ["fold", "feature"])
    own = F.array(*[F.col(f).cast("double") for f in features])
    whole: Column = F.aggregate(F.zip_with(own, "weights", lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v) + F.col("intercept")
    value = F.element_at(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))]), F.col("feature"))
    return (
        joined.withColumn("_full", whole).withColumn("_new", F.col("_full") + F.col("slope") * (F.col("given") - value))
        .groupBy("baseline", F.col("feature").alias("target"), "fold", "repetition")
        .agg(
            F.count("*").alias("n"), F.sum(F.abs(F.col("_new") - F.col(target))).alias("error"),
            F.sum(F.abs(F.col("_full") - F.col(target))).alias("reference"),
        )
        .select(F.lit("permutation").alias("experiment"), "baseline", "target", "fold", "repetition", "n", "error", "reference")
    )


def evidence_rows(sums: DataFrame, split_seed: int = 42) -> DataFrame:
    """Fold rows and pooled rows (from the error sums, never from fold means) with delta and effect."""
    # grouping columns are repeated under new names so that a NULL repetition stays a value
    pooled = sums.groupingSets(
        [[F.col("experiment"), F.col("baseline"), F.col("target"), F.col("repetition"), F.col("fold")],
         [F.col("experiment"), F.col("baseline"), F.col("target"), F.col("repetition")]],
        "experiment", "baseline", "target", "repetition", "fold",
    ).agg(F.sum("n").alias("n"), F.sum("error").alias("e"), F.sum("reference").alias("r"), F.grouping("fold").alias("_pooled"))
    scope = F.when(F.col("_pooled") == 1, "oof").otherwise("fold")
    delta = F.col("e") / F.col("n") - F.col("r") / F.col("n")
    seed = F.when(
        (F.col("experiment") == "permutation") & (F.col("_pooled") == 0),
        permutation_seed(split_seed, F.col("fold"), F.col("target"), F.col("repetition")),
    )
    return pooled.select(
        "experiment", "baseline", "target", scope.alias("scope"), "fold", "repetition", seed.alias("seed"), "n",
        (F.col("r") / F.col("n")).alias("reference"), (F.col("e") / F.col("n")).alias("result"),
        delta.alias("delta"), effect_class(delta).alias("effect"),
    )


def evidence(split: DataFrame, features: list[str], groups: dict[str, tuple[str, ...]], repetitions: int = 10, split_seed: int = 42, n: int | None = None, baselines: dict[str, float] | None = None, permutations: bool = True) -> DataFrame:
    """The evidence table over all three experiments."""
    n = split.count() if n is None else n
    models = fit_models(split, features, groups, baselines or BASELINES)
    sums = fitted_sums(split, features, models)
    if permutations:
        sums = sums.unionByName(permutation_sums(split, features, models, repetitions, split_seed, n))
    return evidence_rows(sums, split_seed)


def canonical_order(evidence_: DataFrame) -> DataFrame:
    """Experiment, baseline, target, fold rows before pooled rows, fold, repetition."""
    return evidence_.orderBy("experiment", "baseline", "target", F.when(F.col("scope") == "fold", 0).otherwise(1), "fold", "repetition")


def recommendations(evidence_: DataFrame, baselines: list[str]) -> DataFrame:
    """Per removal target: any harm keeps it, else any improvement removes it, else it stays."""
    removal = evidence_.where("experiment = 'removal' AND scope = 'oof'")
    wide = removal.groupBy("target").agg(*[F.max(F.when(F.col("baseline") == b, F.col("delta"))).alias(f"delta_{b}") for b in baselines])
    effects = [effect_class(F.col(f"delta_{b}")) for b in baselines]
    found = F.array(*effects)
    verdict = (
        F.when(F.array_contains(found, "harm"), "retain_harm_veto").when(F.array_contains(found, "improvement"), "recommend_removal").otherwise("retain_double_neutral")
    )
    return wide.withColumn("recommendation", verdict)


def permutation_effects(evidence_: DataFrame) -> DataFrame:
    """Mean, smallest and largest pooled permutation delta per baseline and feature."""
    pooled = evidence_.where("experiment = 'permutation' AND scope = 'oof'")
    return pooled.groupBy("baseline", "target").agg(F.avg("delta").alias("mean_delta"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"))


def expected_keys(split: DataFrame, features: list[str], groups: dict[str, tuple[str, ...]], baselines: list[str], repetitions: int) -> DataFrame:
    """The full key grid, expanded from the fold list by arrays."""
    none = F.lit(None).cast("int")
    entries = []
    for experiment, target, _ in variants(features, groups):
        if experiment != "full":
            entries.append(F.struct(F.lit(experiment).alias("experiment"), F.lit(target).alias("target"), F.array(none).alias("reps")))
    reps = F.sequence(F.lit(0), F.lit(repetitions - 1))
    entries += [F.struct(F.lit("permutation").alias("experiment"), F.lit(f).alias("target"), reps.alias("reps")) for f in features]
    folds = split.select("fold").distinct().select(F.col("fold").cast("int").alias("fold"), F.lit("fold").alias("scope"))
    pooled = folds.agg(F.min("scope").alias("scope")).select(none.alias("fold"), F.lit("oof").alias("scope"))
    return (
        folds.unionByName(pooled)
        .select("fold", "scope", F.inline(F.array(*entries)))
        .withColumn("baseline", F.explode(F.array(*[F.lit(b) for b in baselines])))
        .withColumn("repetition", F.explode("reps"))
        .select(*KEY)
    )
