"""Forests grown in tasks: single trees by plain recursion, draws by loops, no model of Spark where a task can hold a fold."""

import numpy as np
import pytest
from pyspark.ml import Estimator
from pyspark.sql import functions as F

from maskwright.operators import estimators, grove, models, neighbours, represented

FULL = {"numTrees": 1, "minInstancesPerNode": 2, "featureSubsetStrategy": "all", "maxDepth": 30, "seed": 1}


def recursion(x, y, w, asked, least, depth):
    """The tree of summed squared errors by trying every split."""
    if not len(asked):
        return np.empty((0, y.shape[1]))
    mean = (w[:, None] * y).sum(0) / w.sum()
    error = lambda m: float((w[m, None] * (y[m] - (w[m, None] * y[m]).sum(0) / w[m].sum()) ** 2).sum())
    best, at = error(np.ones(len(x), bool)) - 1e-9, None
    for k in range(x.shape[1] if depth else 0):
        for b in np.unique(x[:, k])[:-1]:
            left = x[:, k] <= b
            if w[left].sum() >= least and w[~left].sum() >= least and error(left) + error(~left) < best - 1e-9:
                best, at = error(left) + error(~left), (k, b)
    if at is None:
        return np.tile(mean, (len(asked), 1))
    left, down = x[:, at[0]] <= at[1], asked[:, at[0]] <= at[1]
    out = np.empty((len(asked), y.shape[1]))
    out[down] = recursion(x[left], y[left], w[left], asked[down], least, depth - 1)
    out[~down] = recursion(x[~left], y[~left], w[~left], asked[~down], least, depth - 1)
    return out


@pytest.mark.parametrize("few, classes, depth", [(16, 0, 30), (4, 0, 30), (16, 3, 4), (4, 3, 30)])
def test_a_tree_is_that_of_plain_recursion(monkeypatch, few, classes, depth):
    monkeypatch.setattr(grove, "FEW", few)
    rng = np.random.default_rng(few + classes)
    x = rng.integers(0, 9, (70, 3)).astype(np.uint8)
    # no two splits are equally good in other ways than by parting the same rows
    y = (x[:, 0] // 3).astype(float) if classes else rng.normal(size=70) + x[:, 0]
    asked = x[:40]
    rows, total = grove._forest(x, y, asked, np.ones(40, bool), [grove.Subset((0, 1, 2))], {**FULL, "maxDepth": depth}, classes, 0, 1)[0]
    want = recursion(x, np.eye(classes)[y.astype(int)] if classes else y[:, None], np.ones(70), asked, 2, depth)
    assert rows.tolist() == list(range(40)) and total.T == pytest.approx(want, abs=1e-5)


def test_thresholds_part_values():
    assert grove.thresholds(np.array([1.0, 2.0, 5.0]), np.ones(3), 32).tolist() == [1.5, 3.5]
    many = grove.thresholds(np.arange(1000.0), np.ones(1000), 32)
    assert len(many) == 31 and np.diff(np.r_[0, many, 999]).max() < 33
    # nearly all rows have one value: the bins go to the others
    skewed = grove.thresholds(np.arange(100.0), np.r_[9801.0, np.ones(99)], 32)
    assert 20 < len(skewed) < 32
    assert len(grove.thresholds(np.arange(5000.0), np.ones(5000), grove.FINE_BINS)) == 255


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    made = [(k, "g", "r", k % 3, k % 4 + 1, float(rng.normal()), float(rng.integers(0, 50))) for k in range(400)]
    split = spark.createDataFrame(made, "sample_id long, grp string, resolution string, category int, fold int, a double, b double")
    return split.withColumn("target", 3 * F.col("a") + F.abs("b") / 10 + F.sin(F.col("sample_id") * 7)).cache()


@pytest.fixture()
def no_spark_forest(monkeypatch):
    """Spark's estimators hold a whole model on the driver and run a job for each level."""
    def refuse(self, *args, **kwargs):
        raise AssertionError("a model was fitted on the driver")

    monkeypatch.setattr(Estimator, "fit", refuse)


def test_out_of_fold_forest_is_near_that_of_spark(rows):
    recipe = {"numTrees": 30}
    own = {r.sample_id: r for r in models.oof_forest(rows, ["a", "b"], recipe).collect()}
    other = models.oof_model(models.assemble(rows, ["a", "b"]), models.forest(recipe)).collect()
    assert len(own) == 400 and {r.fold for r in own.values()} == {1, 2, 3, 4}
    error = lambda p: np.mean([abs(p(r) - r.target) for r in other])
    assert error(lambda r: own[r.sample_id].predicted) == pytest.approx(error(lambda r: r.predicted), rel=0.1)
    assert own == {r.sample_id: r for r in models.oof_forest(rows.repartition(7), ["a", "b"], recipe).collect()}


@pytest.mark.parametrize("query", ["forest_oof_predictions", "forest_tuning", "scale_ablation"])
def test_oof_forests_and_tables_of_them_fit_no_model_of_spark(rows, no_spark_forest, query):
    small = {"numTrees": 4}
    if query == "forest_oof_predictions":
        assert models.oof_forest(rows, ["a", "b"], small).select("sample_id").distinct().count() == 400
    elif query == "forest_tuning":
        assert models.tuned(rows, ["a", "b"], {"v": {**small, "featureSubsetStrategy": "sqrt", "maxDepth": 3}}, base=small).groupBy("configuration").count().count() == 2
    else:
        assert {r.configuration: r.n for r in models.ablation(rows, {"both": ["a", "b"], "one": ["a"]}, small).collect()} == {"both": 400, "one": 400}


def test_capacity_gap_needs_no_model_on_the_driver_and_shows_memorised_rows(spark, no_spark_forest):
    # 120 training values with a target each: a forest that has 32 bins for them cannot learn the rows by heart
    made = [(k, k // 4 % 2 + 1, float(k // 4), float((k // 4 * 37) % 101)) for k in range(960)]
    split = spark.createDataFrame(made, "sample_id long, fold int, a double, target double")
    got = models.capacity_gap(split, ["a"], (1,), {"numTrees": 12}).collect()
    assert len(got) == 2 and all(r.train_mae < 8 < 16 < r.validation_mae for r in got)


def test_classes_are_told_by_the_share_of_trees(rows, no_spark_forest):
    told = rows.withColumn("kind", F.when(F.col("a") + F.col("b") / 50 > 0.5, "high").when(F.col("a") < -0.5, "low").otherwise("middle"))
    got = models.classification_test(told, ["a", "b"], "kind", trees=20, depth=6).first()
    assert got.balanced_accuracy_mean > 0.85 and got.balanced_accuracy_std < 0.1
    alone = models.classification_test(told.withColumn("kind", F.lit("one")), ["a"], "kind", trees=2).first()
    assert alone.balanced_accuracy_mean == 1.0


def test_forest_evidence_fits_no_model_of_spark(rows, no_spark_forest):
    recipe = {"numTrees": 6, "featureSubsetStrategy": "all"}
    out = estimators.estimator_evidence(rows, ["a", "b"], {"first": ("a",)}, {"forest": estimators.forest_runner(recipe)}, 2).collect()
    got = {(r.experiment, r.target, r.fold, r.repetition): r for r in out}
    error = F.avg(F.abs(F.col("predicted") - F.col("observed")))
    alone = {r.fold: r.e for r in models.oof_forest(rows, ["a", "b"], recipe).groupBy("fold").agg(error.alias("e")).collect()}
    single = {r.fold: r.e for r in models.oof_forest(rows, ["b"], recipe).groupBy("fold").agg(error.alias("e")).collect()}
    for fold in range(1, 5):
        assert got["removal", "a", fold, None].reference == pytest.approx(alone[fold])
        # without a, and without its group, b is left: the forest of b alone
        assert [got["removal", t, fold, None].result for t in ("a", "first")] == pytest.approx([single[fold]] * 2)
        assert got["permutation", "a", fold, 0].result > got["permutation", "a", fold, 0].reference
    assert len([r for r in out if r.experiment == "permutation" and r.scope == "fold"]) == 2 * 2 * 4


@pytest.mark.parametrize("run", ["oof", "classes", "evidence"])
def test_a_fold_that_no_task_could_hold_is_fitted_by_spark(rows, monkeypatch, run):
    monkeypatch.setattr(grove, "TABLE_BYTES", 0)
    recipe = {"numTrees": 2, "maxDepth": 3}
    if run == "oof":
        assert models.oof_forest(rows, ["a", "b"], recipe).count() == 400
    elif run == "classes":
        assert models.classification_test(rows.withColumn("kind", F.when(F.col("a") > 0, "x").otherwise("y")), ["a"], "kind", trees=2, depth=2).first().balanced_accuracy_mean > 0.8
    else:
        out = estimators.estimator_evidence(rows, ["a"], {}, {"forest": estimators.forest_runner(recipe)}, 1)
        assert {r.experiment for r in out.collect()} == {"isolated", "permutation"}


def test_odd_rows_are_errors(rows):
    with pytest.raises(Exception, match="null or NaN"):
        models.oof_forest(rows.withColumn("a", F.when(F.col("sample_id") != 7, F.col("a"))), ["a"], {"numTrees": 1}).count()
    with pytest.raises(Exception, match="no training rows"):
        models.oof_forest(rows.where("fold = 1"), ["a"], {"numTrees": 1}).count()


def _rasters(spark, n):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(k, k % 3 + 1, bytearray(np.packbits(rng.random(64) < 0.2 + 0.6 * (k % 5) / 5).tobytes())) for k in range(n)], "mask_id long, fold int, bits binary")


def test_components_of_all_folds_are_those_of_each(spark):
    rows = _rasters(spark, 60).repartition(3)
    every = neighbours.fold_components(rows, [1, 2, 3], 3, 64)
    for fold, got in every.items():
        want = neighbours.principal_components(rows.where(F.col("fold") != fold).select("bits"), 3, 64)
        assert got.variances == pytest.approx(want.variances) and np.abs(got.directions - want.directions).max() < 1e-6 and got.mean == pytest.approx(want.mean)


@pytest.mark.parametrize("moved", [False, True])
def test_represented_predictions_fit_no_model_of_spark(spark, no_spark_forest, moved):
    bits = _rasters(spark, 60)
    split = bits.select("mask_id", "fold", (F.col("mask_id") % 5 + 1.0).alias("target"))
    plain = represented.Views(bits.select("mask_id", F.col("mask_id").cast("double").alias("m")), bits.select("mask_id", "bits"), bits.select("mask_id", "bits"), ("m",))
    test, owner = plain, None
    if moved:
        twice = lambda d: d.withColumn("mask_id", F.explode(F.array(F.col("mask_id") * 8, F.col("mask_id") * 8 + 1)))
        test, owner = represented.Views(twice(plain.measured), twice(plain.raw), twice(plain.canonical), ("m",)), lambda c: F.expr("mask_id div 8")
    out = represented.represented_predictions(plain, test, split, {"numTrees": 10, "minInstancesPerNode": 2}, 3, 2, 8, owner).collect()
    assert len(out) == (120 if moved else 60) and all(r.fold == r["mask"] % 3 + 1 and 1 <= r.predicted <= 5 for r in out)
    if moved:  # equal views of a mask have equal predictions, to the last bit
        said = {r.mask_id: r.predicted for r in out}
        assert all(said[8 * k] == said[8 * k + 1] for k in range(60))


def test_a_mask_is_turned_without_a_join_of_its_cells(spark):
    import math

    from maskwright.operators import pose

    rng = np.random.default_rng(8)
    frames = {k: rng.random((9 + k, 12)) < 0.6 for k in range(4)}
    runs = []
    for k, raster in frames.items():
        edge = np.diff(np.pad(raster, ((0, 0), (1, 1))).astype(int), axis=1)
        runs += [(k, 9 + k, 12, int(y), int(x0), int(x1) - 1) for (y, x0), x1 in zip(np.argwhere(edge == 1), np.nonzero(edge == -1)[1])]
    turned = pose.rotate(spark.createDataFrame(runs, "mask_id long, h int, w int, y int, x0 int, x1 int"), 25.0)
    assert "Join" not in turned._jdf.queryExecution().executedPlan().toString()
    got = {k: np.zeros(f.shape, bool) for k, f in frames.items()}
    for r in turned.collect():
        assert not got[r.mask_id][r.y, r.x0 : r.x1 + 1].any() and (r.h, r.w) == got[r.mask_id].shape
        got[r.mask_id][r.y, r.x0 : r.x1 + 1] = True
    c, s = math.cos(math.radians(25)), math.sin(math.radians(25))
    for k, f in frames.items():
        cy, cx = (f.shape[0] - 1) / 2, (f.shape[1] - 1) / 2
        for v, u in np.ndindex(f.shape):
            x, y = math.floor(cx + (u - cx) * c - (v - cy) * s + 0.5), math.floor(cy + (u - cx) * s + (v - cy) * c + 0.5)
            assert got[k][v, u] == (0 <= y < f.shape[0] and 0 <= x < f.shape[1] and f[y, x])
