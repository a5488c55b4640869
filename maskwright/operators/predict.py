"""Closed-form out-of-fold predictions from leave-one-fold-out sufficient statistics.

Every estimator here reads the samples once to add up per-fold sums. The training statistics of a
fold are the totals minus that fold's own sums, a table of a few rows that is broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.session import materialize

REFERENCE = "mean_reference"
#: Models (folds x groups) that are broadcast at most; more are joined by sorting.
BROADCAST_MODELS = 100_000


def _moments(features: list[str], target: str) -> list[Column]:
    """Count, means, variances and covariances with the target, which Spark adds up around running means."""
    out = [F.count("*").cast("double").alias("n"), F.avg(target).alias("_my")]
    for f in features:
        out += [F.avg(f).alias(f"_m_{f}"), F.var_pop(f).alias(f"_v_{f}"), F.covar_pop(f, target).alias(f"_c_{f}")]
    return out


def _centred_sums(stats: DataFrame, features: list[str]) -> DataFrame:
    """Sums around the overall means (`cy`, `cx_*`) from the moments of each row's part of the samples.

    Sums around a common centre can be added and subtracted like plain ones, without losing the digits that a
    large offset takes from them.
    """
    # one row per fold (and group)
    everything, n = Window.partitionBy(F.lit(0)), F.col("n")
    centre = lambda c: F.sum(n * F.col(c)).over(everything) / F.sum(n).over(everything)
    stats = stats.withColumns({"cy": centre("_my"), **{f"cx_{f}": centre(f"_m_{f}") for f in features}})
    dy = F.col("_my") - F.col("cy")
    out = {"sy": n * dy}
    for f in features:
        dx = F.col(f"_m_{f}") - F.col(f"cx_{f}")
        out |= {f"sx_{f}": n * dx, f"sxx_{f}": n * (F.col(f"_v_{f}") + dx * dx), f"sxy_{f}": n * (F.col(f"_c_{f}") + dx * dy)}
    return stats.withColumns(out).drop("_my", *[f"{p}_{f}" for f in features for p in ("_m", "_v", "_c")])


def leave_out(stats: DataFrame, names: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Replace per-fold sums by the sums over the other folds (of the same keys)."""
    everything = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return stats.select(
        *keys, "fold", *[(F.sum(c).over(everything) - F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in names]
    )


def line_from_sums(x: str, n: Column, sy: Column) -> tuple[Column, Column]:
    """Slope and intercept of the least-squares line from centred sums; NULL when x has no variance."""
    sx, sxx, sxy = F.col(f"sx_{x}"), F.col(f"sxx_{x}"), F.col(f"sxy_{x}")
    slope = F.try_divide(sxy - sx * sy / n, sxx - sx * sx / n)
    return slope, F.col("cy") + sy / n - slope * (F.col(f"cx_{x}") + sx / n)


def fold_lines(split: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """One row per fold: training mean plus slope and intercept of every single-feature line."""
    stats = _centred_sums(split.groupBy("fold").agg(*_moments(features, target)), features)
    names = ["n", "sy", *[f"{p}_{f}" for f in features for p in ("sx", "sxx", "sxy")]]
    centres = ["cy", *[f"cx_{f}" for f in features]]
    everything = Window.partitionBy(F.lit(0))
    trained = stats.select("fold", *centres, *[(F.sum(c).over(everything) - F.col(c)).alias(c) for c in names])
    n, sy = F.col("n"), F.col("sy")
    lines = []
    for f in features:
        slope, intercept = line_from_sums(f, n, sy)
        lines += [slope.alias(f"slope_{f}"), intercept.alias(f"intercept_{f}")]
    return trained.select("fold", F.col("n").alias("n_train"), (F.col("cy") + sy / n).alias("train_mean"), *lines)


def group_means(split: DataFrame, group: str = "grp", target: str = "target") -> DataFrame:
    """Training mean of each group outside each fold; NULL when the group is only in that fold."""
    stats = split.groupBy(group, "fold").agg(F.count("*").cast("double").alias("n"), F.sum(target).alias("sy"))
    trained = leave_out(stats, ["n", "sy"], (group,))
    return trained.select(group, "fold", F.try_divide(F.col("sy"), F.col("n")).alias("group_mean"))


def fold_group_models(split: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """One row per (fold, group): training mean, group mean and the line of every feature.

    The sums are added up once per (fold, group); windows over that small table turn them into sums
    over the other folds, for all groups and for the own group.
    """
    stats = _centred_sums(split.groupBy("fold", "grp").agg(*_moments(features, target)), features)
    names = ["n", "sy", *[f"{p}_{f}" for f in features for p in ("sx", "sxx", "sxy")]]
    everything, own_fold, own_group = Window.partitionBy(F.lit(0)), Window.partitionBy("fold"), Window.partitionBy("grp")
    trained = stats.select(
        "fold", "grp", "cy", *[f"cx_{f}" for f in features],
        (F.sum("n").over(own_group) - F.col("n")).alias("_gn"), (F.sum("sy").over(own_group) - F.col("sy")).alias("_gy"),
        *[(F.sum(c).over(everything) - F.sum(c).over(own_fold)).alias(c) for c in names],
    )
    n, sy = F.col("n"), F.col("sy")
    lines = []
    for f in features:
        slope, intercept = line_from_sums(f, n, sy)
        lines += [slope.alias(f"slope_{f}"), intercept.alias(f"intercept_{f}")]
    group_mean = F.when(F.col("_gn") > 0, F.col("cy") + F.col("_gy") / F.col("_gn"))
    return trained.select("fold", "grp", (F.col("cy") + sy / n).alias("train_mean"), group_mean.alias("group_mean"), *lines)


def training_mean(split: DataFrame, target: str = "target") -> DataFrame:
    """Each sample with the mean target of the other folds as its prediction."""
    means = fold_lines(split, [], target).select("fold", "train_mean")
    return split.join(F.broadcast(means), "fold").withColumnRenamed("train_mean", "predicted")


def oof_predictions(split: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """Long predictions: the training-mean reference, the group mean and one line per feature.

    A group that a training set lacks falls back to the training mean.
    """
    models = fold_group_models(split, features, target).withColumn("_g", F.struct("grp")).drop("grp")
    models, n_models = materialize(models.withColumn("_row", F.lit(True)), "_row")
    # a struct is equal to another when both hold NULL; left to the planner, a small stored table of samples would be
    # the broadcast side, and every row after the join would come out of the one task of the models
    wide = split.withColumn("_g", F.struct("grp")).join(F.broadcast(models) if n_models <= BROADCAST_MODELS else models.hint("merge"), ["_g", "fold"])

    def entry(name: str, approach: str, role: str, value: Column) -> Column:
        return F.struct(
            F.lit(name).alias("configuration"),
            F.lit(approach).alias("approach"),
            F.lit(role).alias("role"),
            value.cast("double").alias("predicted"),
        )

    entries = [
        entry(REFERENCE, "mean", "reference", F.col("train_mean")),
        entry("group_mean", "mean", "candidate", F.coalesce(F.col("group_mean"), F.col("train_mean"))),
        *[
            entry(f"line_{f}", "least_squares", "candidate",
                  F.coalesce(F.col(f"slope_{f}") * F.col(f) + F.col(f"intercept_{f}"), F.col("train_mean")))
            for f in features
        ],
    ]
    return wide.select(
        "sample_id", "grp", "resolution", "category", "fold", F.col(target).alias("observed"),
        F.inline(F.array(*entries)),
    )


def isolated_predictions(split: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """Held-out predictions of the line on each feature alone, long by feature."""
    lines = fold_lines(split, features, target)
    wide = split.join(F.broadcast(lines), "fold")
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            F.coalesce(F.col(f"slope_{f}") * F.col(f) + F.col(f"intercept_{f}"), F.col("train_mean")).alias("predicted"),
        )
        for f in features
    ]
    return wide.select("sample_id", "category", "fold", F.col(target).alias("observed"), F.inline(F.array(*entries)))


def fold_scales(split: DataFrame, columns: list[str]) -> DataFrame:
    """Training mean and population deviation of each column per fold; zero deviation becomes 1."""
    n = F.col("n")
    stats = _centred_sums(split.groupBy("fold").agg(*_moments(columns, columns[0])), columns)
    everything = Window.partitionBy(F.lit(0))
    names = ["n", *[f"{p}_{c}" for c in columns for p in ("sx", "sxx")]]
    trained = stats.select("fold", *[f"cx_{c}" for c in columns], *[(F.sum(c).over(everything) - F.col(c)).alias(c) for c in names])
    out = []
    for c in columns:
        shift = F.col(f"sx_{c}") / n
        deviation = F.sqrt(F.greatest(F.col(f"sxx_{c}") / n - shift * shift, F.lit(0.0)))
        out += [(F.col(f"cx_{c}") + shift).alias(f"mean_{c}"), F.when(deviation == 0, 1.0).otherwise(deviation).alias(f"sd_{c}")]
    return trained.select("fold", *out)


def standardize(split: DataFrame, columns: list[str]) -> DataFrame:
    """Held-out rows scaled with the statistics of their training folds."""
    scaled = split.join(F.broadcast(fold_scales(split, columns)), "fold")
    return scaled.select(
        *split.columns,
        *[((F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}")).alias(f"z_{c}") for c in columns],
        *[F.col(f"mean_{c}") for c in columns],
        *[F.col(f"sd_{c}") for c in columns],
    )


def transfer_predictions(samples: DataFrame, feature: str, low: float, high: float, target: str = "target") -> DataFrame:
    """Train a line inside one group, test it on every other group, within [low, high] of the target."""
    common = samples.where(F.col(target).between(low, high))
    slope = F.try_divide(F.covar_pop(feature, target), F.var_pop(feature))
    lines = common.groupBy("grp").agg(slope.alias("slope"), (F.avg(target) - slope * F.avg(feature)).alias("intercept")).withColumnRenamed("grp", "train_grp")
    return (
        common.join(lines, F.col("grp") != F.col("train_grp"))
        .withColumn("predicted", F.col("slope") * F.col(feature) + F.col("intercept"))
        .select("train_grp", F.col("grp").alias("test_grp"), F.col(target).alias("observed"), "predicted")
    )
