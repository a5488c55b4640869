"""Out-of-fold predictions with Spark ML estimators; any estimator can be plugged in."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from maskwright.functions import best_epoch
from maskwright.operators import grove
from maskwright.operators.metrics import attach_percentiles, metric_columns
from maskwright.session import materialize, shared_dir

# The forest recipe and its registered variations (Spark's names for the settings).
FOREST = {"numTrees": 500, "minInstancesPerNode": 3, "featureSubsetStrategy": "0.7", "maxDepth": 30, "seed": 44}
VARIATIONS = {
    "rf_tuning_estimators": {"numTrees": 50, "minInstancesPerNode": 2, "featureSubsetStrategy": "0.6", "maxDepth": 30, "seed": 44},
    "rf_tuning_depth": {"numTrees": 30, "minInstancesPerNode": 2, "featureSubsetStrategy": "0.7", "maxDepth": 15, "seed": 44},
    "rf_tuning_features": {"numTrees": 40, "minInstancesPerNode": 3, "featureSubsetStrategy": "sqrt", "maxDepth": 30, "seed": 44},
}
VARIATION_BUDGET = 3
#: Folds that are fitted side by side.
FITS_AT_ONCE = 5


def forest(recipe: dict | None = None, label: str = "target") -> RandomForestRegressor:
    # rows remember their nodes, so that no level sends the trees to the tasks or walks them from the root; the trees are the same
    settings = {"cacheNodeIds": True, **FOREST, **(recipe or {})}
    return RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol="predicted", **settings)


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)


def fold_list(split: DataFrame) -> list[int]:
    return sorted(r["fold"] for r in split.select("fold").distinct().collect())


def oof_model(rows: DataFrame, estimator: Estimator, both_roles: bool = False, restore: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every row predicted by a model that was fitted without its fold.

    `rows` has `fold`, `target` and what the estimator reads. One fit per fold; the scores of the held-out rows
    (of all rows with a `role` column when `both_roles`), without their `features`, are stored as soon as the fold is
    fitted, so that no model outlives its fold on the driver.
    """

    def one(fold: int) -> DataFrame:
        model = estimator.copy().fit(rows.where(F.col("fold") != fold))
        scored = model.transform(rows if both_roles else rows.where(F.col("fold") == fold)).drop("features")
        if restore is not None:
            scored = scored.withColumn("predicted", restore(F.col("predicted")))
        if both_roles:
            scored = scored.withColumn("role", F.when(F.col("fold") == fold, "validation").otherwise("train")).withColumn("outer_fold", F.lit(fold))
        return materialize(scored)[0]

    with ThreadPool(FITS_AT_ONCE) as pool:
        parts = pool.map(inheritable_thread_target(rows.sparkSession)(one), fold_list(rows), chunksize=1)
    return reduce(DataFrame.unionByName, parts)


def oof_forest(split: DataFrame, features: list[str], recipe: dict | None = None, configuration: str = "random_forest", key: str = "sample_id") -> DataFrame:
    """Every sample predicted by a forest without its fold, grown in tasks (`grove`), by Spark's own where a fold's table is too large for a task."""
    told = ["grp", "resolution", "category", "fold", "target"]
    grown = grove.held_out(split.select(key, *told, *[f for f in features if f not in told]), features, "target", {**FOREST, **(recipe or {})}, key)
    predicted = oof_model(assemble(split, features), forest(recipe)) if grown is None else grown.withColumnRenamed("p0", "predicted")
    return predicted.select(
        F.lit(configuration).alias("configuration"), F.lit("random_forest").alias("approach"), F.lit("candidate").alias("role"),
        key, "grp", "resolution", "category", "fold", F.col("target").alias("observed"), "predicted",
    )


def tuned(split: DataFrame, features: list[str], variations: dict[str, dict], budget: int = VARIATION_BUDGET, base: dict | None = None) -> DataFrame:
    """The baseline and at most `budget` registered variations on the same folds, as one long table."""
    if budget < 0 or budget > VARIATION_BUDGET:
        raise ValueError(f"variation budget was {budget}; expected 0 to {VARIATION_BUDGET}")
    out = oof_forest(split, features, base, "random_forest_baseline")
    for name in list(variations)[:budget]:
        out = out.unionByName(oof_forest(split, features, variations[name], name))
    return out


def boosted_with_selected_length(
    inner: DataFrame, split: DataFrame, features: list[str], max_iter: int = 20, least_gain: float = 0.1, patience: int = 20, seed: int = 44
) -> DataFrame:
    """Boosted trees whose number of rounds is chosen on an inner holdout, then refitted in full.

    `inner` holds the outer training rows with `outer_fold` and `inner_role`. The error of every length on the
    stopping rows is walked with an absolute least gain and patience (`best_epoch`). The outer fold never takes
    part in the choice.
    """
    out = None
    training, held = assemble(inner, features), assemble(split, features)
    for fold in fold_list(split):
        train = training.where(F.col("outer_fold") == fold)
        settings = {"featuresCol": "features", "labelCol": "target", "predictionCol": "predicted", "seed": seed, "maxDepth": 3}
        grown = GBTRegressor(maxIter=max_iter, **settings).fit(train.where("inner_role = 'selection'"))
        errors = grown.evaluateEachIteration(train.where("inner_role = 'stopping'"), "absolute")
        walked = best_epoch(F.array(*[F.lit(float(e)) for e in errors]), least_gain, patience)
        chosen = int(split.sparkSession.range(1).select(walked.alias("n")).first()["n"])
        model = GBTRegressor(maxIter=chosen, **settings).fit(train)
        scored = model.transform(held.where(F.col("fold") == fold)).select("sample_id", "fold", "category", F.col("target").alias("observed"), "predicted", F.lit(chosen).alias("rounds"))
        out = scored if out is None else out.unionByName(scored)
    return out


def representation(geometry: list[str], raw: str, canonical: str, raw_parts: int, canonical_parts: int, recipe: dict) -> Pipeline:
    """Geometry with principal components of two pixel vectors, fitted inside each training set."""
    return Pipeline(stages=[
        PCA(k=raw_parts, inputCol=f"{raw}_vec", outputCol="raw_parts"),
        PCA(k=canonical_parts, inputCol=f"{canonical}_vec", outputCol="canonical_parts"),
        VectorAssembler(inputCols=[*geometry, "raw_parts", "canonical_parts"], outputCol="features"),
        forest(recipe, "log_target"),
    ])


def with_vectors(df: DataFrame, *arrays: str) -> DataFrame:
    out = df.withColumn("log_target", F.log("target"))
    for a in arrays:
        out = out.withColumn(f"{a}_vec", array_to_vector(a))
    return out


def capacity_gap(rows: DataFrame, features: list[str], leaves: tuple[int, ...] = (1, 2), recipe: dict | None = None, key: str = "sample_id") -> DataFrame:
    """Train and validation error per fold for several minimum leaf sizes.

    Features have as many bins as there can be: a forest that cannot tell values apart cannot learn its rows by heart, which is
    what the training error is to show.
    """
    out = None
    own = rows.select(F.col("fold").cast("int").alias("fold"), F.col(key).alias("key"), F.col("target").alias("y"), grove.numbers(features).alias("x"))
    planted = grove.planted(own, len(features), {**FOREST, **(recipe or {})}, bins=grove.FINE_BINS)
    if planted is not None:
        asked, _ = materialize(planted.vectors(own.drop("key"), all_folds=True))
        cells, _ = materialize(asked.groupBy("held", "vec").agg(F.lit(True).alias("own")))
    for leaf in leaves:
        if planted is None:
            scored = oof_model(assemble(rows, features), forest({"maxBins": grove.FINE_BINS, **(recipe or {}), "minInstancesPerNode": leaf}), both_roles=True)
        else:
            said = replace(planted, settings={**planted.settings, "minInstancesPerNode": leaf}).said(cells)
            scored = asked.join(said, ["held", "vec"]).select(
                F.col("held").alias("outer_fold"), F.when(F.col("held") == F.col("fold"), "validation").otherwise("train").alias("role"), F.col("p0").alias("predicted"), F.col("y").alias("target")
            )
        error = F.abs(F.col("predicted") - F.col("target"))
        part = scored.groupBy("outer_fold").agg(
            F.avg(F.when(F.col("role") == "train", error)).alias("train_mae"), F.avg(F.when(F.col("role") == "validation", error)).alias("validation_mae")
        ).withColumn("leaf", F.lit(leaf))
        out = part if out is None else out.unionByName(part)
    return out


def ablation(split: DataFrame, sets: dict[str, list[str]], recipe: dict | None = None) -> DataFrame:
    """Pooled error of the forest on several column sets."""
    out = None
    for name, columns in sets.items():
        part = oof_forest(split, columns, recipe, name).groupBy("configuration").agg(*metric_columns())
        out = part if out is None else out.unionByName(part)
    return out


def recall_by_class(predictions: DataFrame, by: list[str]) -> DataFrame:
    hit = (F.col("predicted_label") == F.col("label")).cast("double")
    return predictions.groupBy(*by, "label").agg(F.avg(hit).alias("recall"))


def balanced_accuracy(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Mean recall over the classes that occur, per group."""
    return recall_by_class(predictions, by).groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


def classification_test(rows: DataFrame, features: list[str], label: str, trees: int = 300, depth: int = 10, key: str = "sample_id") -> DataFrame:
    """Mean and population deviation of balanced accuracy over the folds of `rows`."""
    names = sorted(r[0] for r in rows.select(label).distinct().collect() if r[0] is not None)  # a handful of classes
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(label)) - 1
    indexed = rows.where(F.col(label).isNotNull()).drop("label").withColumn("label", number.cast("double"))
    settings = {"numTrees": trees, "minInstancesPerNode": 2, "maxDepth": depth, "seed": 42}
    told = indexed.select(F.col(key).alias("key"), "fold", "label", *[c for c in features if c not in ("key", "fold", "label")])
    grown = grove.held_out(told, features, "label", settings, "key", classes=max(1, len(names)))
    if grown is not None:
        shares = F.array(*[F.col(f"p{k}") for k in range(max(1, len(names)))])
        said = grown.select("fold", "label", (F.array_position(shares, F.array_max(shares)) - 1).cast("double").alias("predicted_label"))
        return _over_folds(said)
    model = RandomForestClassifier(featuresCol="features", labelCol="label", predictionCol="predicted_label", **settings)
    # the scores of a fold are stored before the next: what is sent to tasks is one model
    ready = assemble(indexed, features)
    scored = None
    for fold in fold_list(ready):
        # as stored, without the training summary, which holds the session and cannot go to tasks
        path = f"{shared_dir(ready.sparkSession).rstrip('/')}/maskwright/model-{uuid.uuid4().hex}"
        model.fit(ready.where(F.col("fold") != fold)).write().save(path)
        fitted = RandomForestClassificationModel.load(path)
        part, _ = materialize(fitted.transform(ready.where(F.col("fold") == fold)).select("fold", "label", "predicted_label"))
        scored = part if scored is None else scored.unionByName(part)
    return _over_folds(scored)


def _over_folds(scored: DataFrame) -> DataFrame:
    return balanced_accuracy(scored, ["fold"]).agg(
        F.avg("balanced_accuracy").alias("balanced_accuracy_mean"), F.stddev_pop("balanced_accuracy").alias("balanced_accuracy_std")
    )


def domain_tests(rows: DataFrame, features: list[str], shape: list[str], low: float, high: float, trees: int = 300) -> DataFrame:
    """(test, n, classes, balanced_accuracy_mean, balanced_accuracy_std): can group or resolution be told from the features?

    The group from all features, from the target alone, and from `shape` among the rows whose target lies in [low, high]; the
    most frequent resolution against the others from all features.
    """
    usual = rows.groupBy("resolution").count().orderBy(F.desc("count"), "resolution").limit(1).select(F.col("resolution").alias("_r"))
    labelled = rows.crossJoin(F.broadcast(usual)).withColumn("high", F.when(F.col("resolution") == F.col("_r"), "high").otherwise("low")).drop("_r")
    common = labelled.where(F.col("target").between(low, high))
    out = None
    for name, part, columns, label in (
        ("group_all_features", labelled, features, "grp"), ("group_target_only", labelled, ["target"], "grp"),
        ("resolution_all_features", labelled, features, "high"), ("group_common_support_shape", common, shape, "grp"),
    ):
        sizes = part.agg(F.count("*").alias("n"), F.count_distinct(label).alias("classes"))
        tested, _ = materialize(classification_test(part, columns, label, trees))
        row = tested.crossJoin(sizes).select(F.lit(name).alias("test"), "n", "classes", "balanced_accuracy_mean", "balanced_accuracy_std")
        out = row if out is None else out.unionByName(row)
    return out


def robustness(rows: DataFrame, estimator: Estimator, key: str = "mask_id", restore: Callable[[Column], Column] | None = None) -> DataFrame:
    """Metrics per scenario of models fitted on original masks, with the change of the prediction.

    `rows` has one row per mask and `scenario`; only `original` rows train.
    """
    out = None
    for fold in fold_list(rows):
        model = estimator.fit(rows.where((F.col("fold") != fold) & (F.col("scenario") == "original")))
        scored = model.transform(rows.where(F.col("fold") == fold))
        scored = scored.withColumn("predicted", restore(F.col("predicted"))) if restore else scored
        scored = scored.select(key, "scenario", F.col("target").alias("observed"), "predicted")
        out = scored if out is None else out.unionByName(scored)
    return robustness_summary(out, key)


def robustness_summary(predictions: DataFrame, key: str = "mask_id") -> DataFrame:
    """Metrics per scenario with mean and p90 of the change against the original mask."""
    base = predictions.where("scenario = 'original'").select(key, F.col("predicted").alias("original"))
    changed = predictions.join(base, key).withColumn("change", F.abs(F.col("predicted") - F.col("original")))
    sums = changed.groupBy("scenario").agg(*metric_columns(), F.avg("change").alias("mean_prediction_change"))
    return attach_percentiles(sums, changed, ["scenario"], "change", {"p90_prediction_change": 0.9})
