"""Queries: Spark ML models on the folds.

Trees of another library cannot be compared number by number, so the checked rows are what must hold of them:
every sample predicted once by a model without its fold, fold sizes, errors against the mean, bounds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import r6
from maskwright.operators import aligned, geometry, models, morphology, pose, predict, represented, split
from maskwright.plans import forms
from maskwright.plans.common import masks_split, samples_split
from maskwright.plans.evaluation import FULL, rounded
from maskwright.plans.oracle import fragment, q, r6 as sql_r6
from maskwright.plans.registry import query
from maskwright.plans.shapes import grid_runs
from maskwright.session import materialize
from maskwright.sources import tables

FEATURES = ["words", "lines", "digits"]
LEARNING, ABLATION, ROBUST = {"numTrees": 200, "minInstancesPerNode": 2}, {"numTrees": 500, "minInstancesPerNode": 2}, {"numTrees": 300, "minInstancesPerNode": 2}
SHAPE = ["solidity", "circularity", "aspect_ratio", "extent", "convexity", "hu_moment_1", "hu_moment_2", "center_to_end_occupancy_ratio", "centroid_x_offset", "centroid_y_ratio"]


def stored_split(spark, sf):
    """The split table, stored once: every fold of every model reads it."""
    stored, _ = materialize(samples_split(spark, sf, tuple(FEATURES)))
    return stored


FOLD_SIZES = "SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n, count(DISTINCT sample_id) AS samples, TRUE AS holds FROM s_split GROUP BY fold"


def fold_checks(scored, holds):
    """Per fold: rows, different samples, and whether an aggregate condition holds."""
    return scored.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("samples"), holds.alias("holds"))


def beats_the_mean(scored, split_rows):
    """The scored rows with the training mean as `reference`, and the condition that their error is smaller."""
    means = predict.training_mean(split_rows).select("sample_id", F.col("predicted").alias("reference"))
    better = F.avg(F.abs(F.col("predicted") - F.col("observed"))) < F.avg(F.abs(F.col("reference") - F.col("observed")))
    return fold_checks(scored.join(means, "sample_id"), better)


@query("forest_oof_predictions", q(FOLD_SIZES))
def forest_oof_predictions(spark, sf):
    rows = stored_split(spark, sf)
    return beats_the_mean(models.oof_forest(rows, FEATURES), rows)


@query("forest_tuning", q("SELECT unnest(['rf_tuning_estimators', 'rf_tuning_depth', 'rf_tuning_features']) AS configuration, (SELECT count(*) FROM documents) AS n, TRUE AS holds"))
def forest_tuning(spark, sf):
    from maskwright.operators.diagnostics import variation_table

    rows = variation_table(models.tuned(stored_split(spark, sf), FEATURES, models.VARIATIONS), "random_forest_baseline")
    holds = (F.col("rmse") >= F.col("mae")) & (F.col("r2") > 0.5) & (F.abs(F.col("mae") - F.col("baseline_mae") - F.col("delta_mae")) < 1e-9) & (F.col("mae") < 1.5 * F.col("baseline_mae"))
    return rows.select("configuration", "n", holds.alias("holds"))


@query("boosted_selected_length", q(FOLD_SIZES))
def boosted_selected_length(spark, sf):
    rows = stored_split(spark, sf)
    inner, _ = materialize(split.inner_holdout(rows, n=rows.count()))
    scored, _ = materialize(models.boosted_with_selected_length(inner, rows, FEATURES))
    lengths = scored.groupBy("fold").agg(((F.min("rounds") == F.max("rounds")) & F.max("rounds").between(1, 20)).alias("one_length")).withColumn("fold", F.col("fold").cast("long"))
    return beats_the_mean(scored, rows).join(lengths, "fold").withColumn("holds", F.col("holds") & F.col("one_length")).drop("one_length")


@query("domain_classification", q("""
SELECT u.test, CASE WHEN u.test = 'group_common_support_shape' THEN (SELECT count(*) FROM s_base WHERE target BETWEEN 92 AND 2650) ELSE (SELECT count(*) FROM s_base) END AS n,
  CASE WHEN u.test LIKE 'group%' THEN (SELECT count(DISTINCT grp) FROM s_base WHERE u.test <> 'group_common_support_shape' OR target BETWEEN 92 AND 2650) ELSE 2 END AS classes, u.told AS told, TRUE AS even
FROM (SELECT unnest(['group_all_features', 'group_target_only', 'resolution_all_features', 'group_common_support_shape']) AS test, unnest(['yes', 'any', 'any', 'any']) AS told) AS u"""))
def domain_classification(spark, sf):
    """Four tests. All features tell the language better than guessing; `even`: the spread over folds is one that folds can have."""
    rows, _ = materialize(samples_split(spark, sf, (*FEATURES, "commas", "capitals", "distinct_words")))
    shaped = rows.withColumn("words_per_line", F.col("words") / F.col("lines")).withColumn("digit_share", F.col("digits") / F.col("words"))
    out = models.domain_tests(shaped, [*FEATURES, "commas", "capitals", "distinct_words"], ["words_per_line", "digit_share"], 92.0, 2650.0)
    mean = F.col("balanced_accuracy_mean")
    told = F.when(F.col("test") != "group_all_features", "any").when(mean > 1.1 / F.col("classes"), "yes").otherwise("no")
    return out.select("test", "n", "classes", told.alias("told"), (mean.between(0, 1) & (F.col("balanced_accuracy_std") < 0.3)).alias("even"))


fragment("k_rows", """
SELECT CAST(fold AS BIGINT) AS fold, quality AS label, CAST(target >= train_mean AS INT) AS predicted_label FROM s_wide JOIN labels ON doc_id = sample_id""")


@query("balanced_accuracy", q("SELECT fold, " + sql_r6("avg(recall)", "balanced_accuracy", 5) + " FROM (SELECT fold, label, avg(CASE WHEN label = predicted_label THEN 1.0 ELSE 0.0 END) AS recall FROM k_rows GROUP BY fold, label) GROUP BY fold"))
def balanced_accuracy(spark, sf):
    rows = predict.training_mean(samples_split(spark, sf)).join(tables.table(spark, sf, "labels").withColumnRenamed("doc_id", "sample_id"), "sample_id")
    scored = rows.select(F.col("fold").cast("long").alias("fold"), F.col("quality").alias("label"), (F.col("target") >= F.col("predicted")).cast("int").alias("predicted_label"))
    return models.balanced_accuracy(scored, ["fold"]).select("fold", r6(F.col("balanced_accuracy"), 5).alias("balanced_accuracy"))


@query("capacity_gap", q("SELECT CAST(f AS BIGINT) AS outer_fold, CAST(leaf AS BIGINT) AS leaf, TRUE AS overfits, TRUE AS useful FROM (SELECT unnest(range(1, 6)) AS f), (SELECT unnest([1, 2]) AS leaf)"))
def capacity_gap(spark, sf):
    """`overfits`: the error on training rows is smaller; `useful`: that on held-out rows is below half of the fold mean's."""
    rows = stored_split(spark, sf)
    out = models.capacity_gap(rows, FEATURES, recipe=LEARNING)
    means = predict.training_mean(rows).groupBy(F.col("fold").alias("outer_fold")).agg(F.avg(F.abs(F.col("predicted") - F.col("target"))).alias("mean_mae"))
    return out.join(F.broadcast(means), "outer_fold").select(
        F.col("outer_fold").cast("long").alias("outer_fold"), F.col("leaf").cast("long").alias("leaf"), (F.col("train_mae") < F.col("validation_mae")).alias("overfits"), (F.col("validation_mae") < 0.5 * F.col("mean_mae")).alias("useful")
    )


def within_band(mae, reference):
    """An error that a model of unrelated masks can have: around that of the mean of the other folds."""
    return mae.between(0.5 * reference, 1.5 * reference)


@query("scale_ablation", q("SELECT unnest(['all_features', 'shape_only', 'area_only']) AS configuration, (SELECT count(*) FROM embeddings) AS n, TRUE AS banded"))
def scale_ablation(spark, sf):
    measured = geometry.measure(grid_runs(spark, sf)).select("mask_id", *geometry.FEATURES).fillna(0.0)
    rows, _ = materialize(masks_split(spark, sf).join(measured, "mask_id").withColumnRenamed("mask_id", "sample_id"))
    mean = predict.training_mean(rows).agg(F.avg(F.abs(F.col("predicted") - F.col("target"))).alias("m"))
    out = models.ablation(rows, {"all_features": list(geometry.FEATURES), "shape_only": SHAPE, "area_only": ["area"]}, ABLATION)
    return out.crossJoin(F.broadcast(mean)).select("configuration", "n", within_band(F.col("mae"), F.col("m")).alias("banded"))


def views(measured, stretched, side=represented.SIDE):
    """The tables of the representation from masks on their stretched frames, stored."""
    raw, _ = materialize(aligned.packed(stretched, side))
    canonical, _ = materialize(aligned.canonical_bits(stretched, side, max(side, aligned.WORKING)))
    stored, _ = materialize(measured.select("mask_id", *geometry.FEATURES).fillna(0.0))
    return represented.Views(stored, raw, canonical, geometry.FEATURES)


@query("pixel_representation", q("SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n, count(*) AS samples, TRUE AS banded FROM m_split GROUP BY fold"))
def pixel_representation(spark, sf):
    """26 measurements, 24 components of stretched and 16 of aligned 96 x 96 rasters, log target, 200 trees, all inside each training set."""
    shapes = forms.shapes(spark, sf)
    own = views(geometry.measure(shapes), pose.resize(shapes, represented.SIDE, "stretch"))
    split_rows, _ = materialize(masks_split(spark, sf))
    scored = represented.represented_predictions(own, own, split_rows, LEARNING).join(split_rows.select("mask_id", "target"), "mask_id")
    means = predict.training_mean(split_rows.withColumnRenamed("mask_id", "sample_id")).select(F.col("sample_id").alias("mask_id"), F.abs(F.col("predicted") - F.col("target")).alias("m"))
    banded = within_band(F.avg(F.abs(F.col("predicted") - F.col("target"))), F.avg("m"))
    return scored.join(means, "mask_id").groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"), F.count_distinct("mask_id").alias("samples"), banded.alias("banded"))


SCENARIOS = ["original", "erosion_1", "erosion_2", "dilation_1", "dilation_2", "shift_4", "rotation_5"]


@query("mask_robustness", q(f"SELECT unnest({SCENARIOS}) AS scenario, (SELECT count(*) FROM embeddings) AS n, TRUE AS banded, unnest([TRUE, FALSE, FALSE, FALSE, FALSE, FALSE, FALSE]) AS unmoved"))
def mask_robustness(spark, sf):
    """Every scenario of the 96 x 96 masks by the models fitted on the originals, components included; `unmoved`: no prediction changed."""
    stretched, _ = materialize(pose.resize(forms.shapes(spark, sf), represented.SIDE, "stretch"))
    every = morphology.scenarios(stretched).unionByName(pose.rotate(stretched, 5.0).withColumn("scenario", F.lit("rotation_5")))
    number = F.array_position(F.array(*[F.lit(x) for x in SCENARIOS]), F.col("scenario")) - 1
    # one number for mask and scenario; a scenario that erases a mask leaves it without cells
    coded, _ = materialize(every.withColumn("mask_id", F.col("mask_id") * 8 + number).select("mask_id", "h", "w", "y", "x0", "x1"))
    split_rows, _ = materialize(masks_split(spark, sf))
    train = views(geometry.measure(stretched), stretched)
    scored = represented.represented_predictions(train, views(geometry.measure(coded), coded), split_rows, ROBUST, owner=lambda c: F.expr("mask_id div 8"))
    named = scored.select(F.col("mask").alias("mask_id"), F.element_at(F.array(*[F.lit(x) for x in SCENARIOS]), (F.pmod("mask_id", F.lit(8)) + 1).cast("int")).alias("scenario"), "predicted")
    summary = models.robustness_summary(named.join(split_rows.select("mask_id", F.col("target").alias("observed")), "mask_id"))
    mean = predict.training_mean(split_rows.withColumnRenamed("mask_id", "sample_id")).agg(F.avg(F.abs(F.col("predicted") - F.col("target"))).alias("m"))
    return summary.crossJoin(F.broadcast(mean)).select("scenario", "n", within_band(F.col("mae"), F.col("m")).alias("banded"), (F.col("mean_prediction_change") == 0).alias("unmoved"))


fragment("rb_rows", """
SELECT m.mask_id, scenario, target AS observed, slope * (a * pow(1024.0 / (41 + m.mask_id % 4), 2)) + icpt AS predicted FROM m_split m JOIN m_lines USING (fold) JOIN (
  SELECT mask_id, 'original' AS scenario, count(*) AS a FROM v_cells GROUP BY 1 UNION ALL SELECT mask_id, 'erosion_1', count(*) FROM v1_ero GROUP BY 1
  UNION ALL SELECT mask_id, 'dilation_1', count(*) FROM v1_dil GROUP BY 1 UNION ALL SELECT mask_id, 'dilation_2', count(*) FROM vd_dil GROUP BY 1
  UNION ALL SELECT mask_id, 'erosion_2', count(*) FROM vd_ero GROUP BY 1 UNION ALL SELECT mask_id, 'shift_4', count(*) FROM v_cells WHERE x + 4 < side GROUP BY 1) USING (mask_id)""")


@query("scenario_change", q("SELECT r.scenario, " + FULL.replace("observed", "r.observed").replace("predicted", "r.predicted") + ", " + sql_r6("avg(abs(r.predicted - o.predicted))", "mean_prediction_change", 4) + ", " + sql_r6("quantile_cont(abs(r.predicted - o.predicted), 0.9)", "p90_prediction_change", 4) + " FROM rb_rows r JOIN rb_rows o ON o.mask_id = r.mask_id AND o.scenario = 'original' GROUP BY r.scenario"))
def scenario_change(spark, sf):
    from maskwright.operators.sensitivity import scaled_features

    keys = ["mask_id", "h", "w", "scenario"]
    measured, _ = materialize(scaled_features(morphology.scenarios(forms.shapes(spark, sf)), keys, ["area"], 1024))
    rows = masks_split(spark, sf).join(measured, "mask_id")
    lines = predict.fold_lines(rows.where("scenario = 'original'"), ["area"])
    scored = rows.join(F.broadcast(lines), "fold").select(
        "mask_id", "scenario", F.col("target").alias("observed"), (F.col("slope_area") * F.col("area") + F.col("intercept_area")).alias("predicted")
    )
    return rounded(models.robustness_summary(scored), "mae", "rmse", "bias", "r2", "mean_prediction_change", "p90_prediction_change")
