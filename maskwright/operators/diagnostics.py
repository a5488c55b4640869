"""Diagnostics of predictions: coverage, strata, groups, residual correlation, notable cases, curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import pearson
from maskwright.operators.metrics import attach_percentiles
from maskwright.operators.ranks import group_percentiles
from maskwright.operators.split import hash_order, position_in_group, prefix_digits
from maskwright.session import materialize

DIMENSIONS = ("category", "grp", "resolution")


def coverage(split: DataFrame) -> DataFrame:
    """Sample counts by category, group and resolution in one pass (long form)."""
    strata = F.array(*[F.struct(F.lit(d).alias("stratum_type"), F.col(d).cast("string").alias("stratum_value")) for d in DIMENSIONS])
    return split.select(F.inline(strata)).groupBy("stratum_type", "stratum_value").agg(F.count("*").alias("sample_count"))


def cross_tabs(split: DataFrame) -> DataFrame:
    """The three pairwise counts of category, group and resolution (long form)."""
    pairs = [(a, b) for i, a in enumerate(DIMENSIONS) for b in DIMENSIONS[i + 1:]]
    entries = F.array(*[
        F.struct(F.lit(a).alias("dim_a"), F.lit(b).alias("dim_b"), F.col(a).alias("value_a"), F.col(b).alias("value_b"))
        for a, b in pairs
    ])
    return split.select(F.inline(entries)).groupBy("dim_a", "dim_b", "value_a", "value_b").agg(F.count("*").alias("n"))


def _errors_by(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count, mae, median absolute error and bias of residuals `r` per group."""
    sums = rows.groupBy(*by).agg(F.count("*").alias("sample_count"), F.avg(F.abs("r")).alias("mae"), F.avg("r").alias("bias"))
    found = attach_percentiles(sums, rows.withColumn("e", F.abs("r")), by, "e", {"median_ae": 0.5})
    return found.select(*by, "sample_count", "mae", "median_ae", "bias")


def stratified(predictions: DataFrame, minimum_resolution: int = 10) -> DataFrame:
    """n, mae, median error and bias per configuration and stratum; thin resolutions are left out."""
    strata = F.array(*[F.struct(F.lit(d).alias("stratum_type"), F.col(d).cast("string").alias("stratum_value")) for d in DIMENSIONS])
    r = F.col("predicted") - F.col("observed")
    rows = predictions.select("configuration", "role", r.alias("r"), F.inline(strata))
    return _errors_by(rows, ["configuration", "role", "stratum_type", "stratum_value"]).where(
        (F.col("stratum_type") != "resolution") | (F.col("sample_count") >= minimum_resolution)
    )


def group_comparison(predictions: DataFrame, low: float, high: float) -> DataFrame:
    """The groups side by side on the full sample and inside a shared target range."""
    scopes = F.filter(
        F.array(F.lit("full_sample"), F.when(F.col("observed").between(low, high), F.lit("shared_range"))), lambda s: s.isNotNull()
    )
    r = F.col("predicted") - F.col("observed")
    rows = predictions.select("configuration", "role", "grp", r.alias("r"), F.explode(scopes).alias("sample_scope"))
    return _errors_by(rows, ["configuration", "role", "sample_scope", "grp"])


def residual_table(predictions: DataFrame, configurations: list[str]) -> DataFrame:
    """One row per sample with a residual column per configuration."""
    r = F.col("predicted") - F.col("observed")
    return predictions.groupBy("sample_id").agg(
        *[F.max(F.when(F.col("configuration") == c, r)).alias(f"r_{c}") for c in configurations]
    )


def residual_correlations(predictions: DataFrame, configurations: list[str]) -> DataFrame:
    """Pearson of signed residuals for every ordered pair of configurations, paired by sample.

    The residuals are pivoted to columns once, so the pairs cost aggregates and no self-join.
    Without variance the value is 1 for equal series and 0 otherwise; below two pairs it is NULL.
    """
    wide = residual_table(predictions, configurations)
    aggregates, names = [], []
    for i, a in enumerate(configurations):
        for b in configurations[i:]:
            x, y = F.col(f"r_{a}"), F.col(f"r_{b}")
            both = x.isNotNull() & y.isNotNull()
            px, py = F.when(both, x), F.when(both, y)
            equal = F.coalesce(F.max(F.abs(px - py)), F.lit(1.0)) == 0
            n = F.count(F.when(both, 1))
            value = F.when(n < 2, None).otherwise(F.coalesce(pearson(px, py), F.when(equal, 1.0).otherwise(0.0)))
            aggregates.append(F.struct(n.alias("n"), value.alias("pearson")).alias(f"p_{a}__{b}"))
            names.append((a, b))
    row = wide.agg(*aggregates)
    entries = []
    for a, b in names:
        for left, right in {(a, b), (b, a)}:
            cell = F.col(f"p_{a}__{b}")
            entries.append(F.struct(
                F.lit(left).alias("configuration_1"), F.lit(right).alias("configuration_2"),
                cell["n"].alias("n"), cell["pearson"].alias("pearson"),
            ))
    return row.select(F.inline(F.array(*entries)))


def _cases(predictions: DataFrame, configurations: list[str]) -> DataFrame:
    """Predictions as one row per sample: dimensions plus a column per configuration."""
    kept = predictions.where(F.col("configuration").isin(configurations))
    return kept.groupBy("sample_id").agg(
        *[F.min(c).alias(c) for c in ("observed", "category", "grp", "resolution")],
        *[F.max(F.when(F.col("configuration") == c, F.col("predicted"))).alias(c) for c in configurations],
    )


def notable_cases(predictions: DataFrame, configurations: list[str], percentile: float = 0.9, minimum: int = 3) -> DataFrame:
    """Samples hard for several models at once, and samples on which the models disagree most.

    Hard: absolute error at or above that configuration's percentile in at least `minimum`
    configurations. Divergent: range of predictions at or above the percentile of the ranges.
    """
    wide = _cases(predictions, configurations)
    errors = {c: F.abs(F.col(c) - F.col("observed")) for c in configurations}
    present = [F.col(c) for c in configurations]
    spread = F.greatest(*present) - F.least(*present)
    series = F.array(*[F.struct(F.lit(f"_q_{c}").alias("series"), errors[c].alias("value")) for c in configurations], F.struct(F.lit("_q_spread").alias("series"), spread.alias("value")))
    found = group_percentiles(wide.select(F.inline(series)), ["series"], "value", {"q": percentile})
    limits = found.agg(*[F.max(F.when(F.col("series") == s, F.col("q"))).alias(s) for s in [*[f"_q_{c}" for c in configurations], "_q_spread"]])
    # thresholds are a single row of len(configurations) + 1 numbers
    joined = wide.withColumn("_k", F.lit(0)).join(F.broadcast(limits.withColumn("_k", F.lit(0))), "_k")
    hits = sum((F.when(errors[c] >= F.col(f"_q_{c}"), 1).otherwise(0) for c in configurations), F.lit(0))
    kinds = F.filter(
        F.array(
            F.struct(F.lit("shared_hard_case").alias("case_type"), F.when(hits >= minimum, hits.cast("double")).alias("metric_value")),
            F.struct(F.lit("divergent_case").alias("case_type"), F.when(spread >= F.col("_q_spread"), spread).alias("metric_value")),
        ),
        lambda s: s["metric_value"].isNotNull(),
    )
    return joined.select("sample_id", F.inline(kinds), "observed", "category", "grp", "resolution", *configurations)


def learning_points(subsets: DataFrame, split: DataFrame, feature: str, target: str = "target") -> DataFrame:
    """mae and bias on the held-out fold of a line fitted on each training subset."""
    fits = subsets.groupBy("outer_fold", "fraction").agg(
        F.count("*").alias("n_train"), F.regr_slope(target, feature).alias("slope"), F.regr_intercept(target, feature).alias("intercept")
    )
    fits = fits.select(F.col("outer_fold").alias("fold"), "fraction", "n_train", "slope", "intercept")
    r = F.col("slope") * F.col(feature) + F.col("intercept") - F.col(target)
    return (
        split.join(F.broadcast(fits), "fold")
        .groupBy("fold", "fraction", "n_train")
        .agg(F.count("*").alias("n_eval"), F.avg(F.abs(r)).alias("mae"), F.avg(r).alias("bias"))
    )


def reused_points(predictions: DataFrame, configuration: str, n_by_fold: DataFrame) -> DataFrame:
    """The full-size learning point of a configuration from its stored predictions."""
    r = F.col("predicted") - F.col("observed")
    scored = predictions.where(F.col("configuration") == configuration).groupBy("fold").agg(
        F.count("*").alias("n_eval"), F.avg(F.abs(r)).alias("mae"), F.avg(r).alias("bias")
    )
    return scored.join(F.broadcast(n_by_fold), "fold").withColumn("fraction", F.lit(1.0)).withColumn("action", F.lit("reused"))


def learning_summary(points: DataFrame) -> DataFrame:
    return points.groupBy("configuration", "fraction").agg(
        F.avg("n_train").alias("mean_n_train"), F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("std_mae"),
        F.avg("bias").alias("mean_bias"), F.count(F.when(F.col("action") == "reused", 1)).alias("reused_points"),
    )


def curve_grid(summary: DataFrame, fractions: list[float]) -> DataFrame:
    """mean mae for every configuration and wanted fraction; NULL where no point exists."""
    wanted = summary.select("configuration").distinct().withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    return wanted.join(summary.select("configuration", "fraction", "mean_mae"), ["configuration", "fraction"], "left")


def learning_rows(subsets: DataFrame, split: DataFrame, feature: str, heavy_quantile: float = 0.8, target: str = "target") -> DataFrame:
    """Train, validation and heavy-tail validation mae per (fold, fraction)."""
    fits = subsets.groupBy("outer_fold", "fraction").agg(
        F.count("*").alias("n_train"), F.regr_slope(target, feature).alias("slope"), F.regr_intercept(target, feature).alias("intercept")
    )
    limit = group_percentiles(split, [], target, {"heavy": heavy_quantile}).withColumn("_k", F.lit(0))
    error = F.abs(F.col("slope") * F.col(feature) + F.col("intercept") - F.col(target))
    train = subsets.join(F.broadcast(fits), ["outer_fold", "fraction"]).groupBy("outer_fold", "fraction").agg(F.avg(error).alias("train_mae"))
    held = (
        split.withColumnRenamed("fold", "outer_fold").withColumn("_k", F.lit(0))
        .join(F.broadcast(fits), "outer_fold").join(F.broadcast(limit), "_k")
        .groupBy("outer_fold", "fraction", "n_train")
        .agg(F.avg(error).alias("validation_mae"), F.avg(F.when(F.col(target) >= F.col("heavy"), error)).alias("heavy_mae"))
    )
    return held.join(F.broadcast(train), ["outer_fold", "fraction"])


def repeated_learning_rows(
    splits: DataFrame, feature: str, n: int, fractions: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0), heavy_quantile: float = 0.8, target: str = "target", key: str = "sample_id", strata: int = 50,
) -> DataFrame:
    """(split_seed, outer_fold, fraction, n_train, train_mae, validation_mae, heavy_mae) of a line on `feature`, for every seed, fold and fraction.

    `splits` has `split_seed`, `fold` and `category` (of `repeated_splits`). A row's place in the hash order of its (seed, fold, category)
    says which fractions it belongs to, so the subsets are nested and one set of flags serves all outer folds: sums of
    each (seed, fraction, fold) come from one pass, a training set is their total less the held-out fold, and all errors of
    all lines (seeds * fractions * folds of them, broadcast) come from a second. A cell gives floor(size * fraction + 0.5) rows.
    """
    cell = ["split_seed", "fold", "category"]
    order = hash_order(F.col("split_seed") * 101, key)
    sizes = splits.groupBy(*cell).agg(F.count("*").alias("_size"))
    placed = position_in_group(splits.select(*cell, key, target, feature).withColumn("_h", order), cell, "_h", key, prefix_digits(n / strata), "_p")
    flag = lambda q: F.when(F.col("_p") < F.floor(F.col("_size") * q + 0.5), F.lit(q))
    rows, _ = materialize(
        placed.join(F.broadcast(sizes), cell).select(
            "split_seed", "fold", F.col(target).cast("double").alias("y"), F.col(feature).cast("double").alias("x"), F.array_compact(F.array(*[flag(q) for q in fractions])).alias("member")
        )
    )
    stats = rows.select("split_seed", "fold", "x", "y", F.explode("member").alias("fraction")).groupBy("split_seed", "fraction", "fold").agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.covar_pop("x", "y").alias("cxy")
    )
    # a table of seeds * fractions * folds rows; sums around a common centre can be subtracted
    every, whole = Window.partitionBy(F.lit(0)), Window.partitionBy("split_seed", "fraction")
    centred = stats.withColumn("cx", F.avg("mx").over(every)).withColumn("cy", F.avg("my").over(every))
    dx, dy, count = F.col("mx") - F.col("cx"), F.col("my") - F.col("cy"), F.col("n")
    sums = centred.select("split_seed", "fraction", "fold", "n", "cx", "cy", (count * dx).alias("sx"), (count * dy).alias("sy"), (count * (F.col("vx") + dx * dx)).alias("sxx"), (count * (F.col("cxy") + dx * dy)).alias("sxy"))
    left = sums.select("split_seed", "fraction", "fold", "cx", "cy", *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    slope = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / count, F.col("sxx") - F.col("sx") * F.col("sx") / count)
    fits = left.select(
        "split_seed", F.struct("fraction", F.col("fold").alias("outer_fold"), count.alias("n_train"), slope.alias("slope"), (F.col("cy") + F.col("sy") / count - slope * (F.col("cx") + F.col("sx") / count)).alias("intercept")).alias("line")
    ).groupBy("split_seed").agg(F.collect_list("line").alias("lines"))
    limit = group_percentiles(splits.where(F.col("split_seed") == F.lit(splits.agg(F.min("split_seed")).first()[0])), [], target, {"heavy": heavy_quantile}).first()
    heavy = F.lit(None if limit is None else limit["heavy"]).cast("double")
    scored = rows.join(F.broadcast(fits), "split_seed").select("split_seed", "fold", "y", "member", "x", F.explode("lines").alias("l")).select("split_seed", "fold", "y", "member", "x", "l.*")
    error, held = F.abs(F.col("slope") * F.col("x") + F.col("intercept") - F.col("y")), F.col("fold") == F.col("outer_fold")
    return scored.groupBy("split_seed", "outer_fold", "fraction", "n_train").agg(
        F.avg(F.when(~held & F.array_contains("member", F.col("fraction")), error)).alias("train_mae"), F.avg(F.when(held, error)).alias("validation_mae"),
        F.avg(F.when(held & (F.col("y") >= heavy), error)).alias("heavy_mae"),
    )


def repeated_curve(rows: DataFrame) -> DataFrame:
    """Mean and population deviation by fraction over all splits and folds."""
    values = ["n_train", "train_mae", "validation_mae", "heavy_mae"]
    return rows.groupBy("fraction").agg(
        *[F.avg(v).alias(f"mean_{v}") for v in values], *[F.stddev_pop(v).alias(f"sd_{v}") for v in values]
    )


def variation_table(predictions: DataFrame, baseline: str) -> DataFrame:
    """Pooled metrics of each configuration next to the baseline, with the mae difference."""
    from maskwright.operators.metrics import metric_columns

    pooled = predictions.groupBy("configuration").agg(*metric_columns())
    base = pooled.where(F.col("configuration") == baseline).select(F.col("mae").alias("baseline_mae"), F.lit(0).alias("_k"))
    return (
        pooled.where(F.col("configuration") != baseline).withColumn("_k", F.lit(0)).join(F.broadcast(base), "_k").drop("_k")
        .withColumn("delta_mae", F.col("mae") - F.col("baseline_mae"))
    )


def sensitivity_summary(records: DataFrame) -> DataFrame:
    """Mean absolute and mean prediction change with counts, by perturbation and status."""
    return records.groupBy("perturbation", "status").agg(
        F.count("*").alias("n"), F.avg(F.abs("delta")).alias("mean_abs_delta"), F.avg("delta").alias("mean_delta")
    )


def rejection_counts(eligibility: DataFrame) -> DataFrame:
    return eligibility.groupBy("status", "reason").agg(F.count("*").alias("n"))
