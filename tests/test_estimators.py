"""Evidence through plugged-in estimators, resamples by plain loops, changed rows by key."""

import hashlib
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.operators import estimators, fingerprint, metrics


class Halfway:
    """A fake model: the mean of the training target plus half of the first feature."""

    nbytes = 8

    def __init__(self, mean):
        self.mean = mean

    def predict(self, x):
        return self.mean + x[:, 0] / 2


class FakeRunner:
    def __init__(self, sent):
        self.sent, self.fits, self.lock = sent, [], threading.Lock()

    def fit(self, rows, features, target):
        mean = rows.agg(F.avg(target)).first()[0]
        with self.lock:
            self.fits.append(tuple(features))

        return (Halfway(mean) if self.sent else None), lambda df: _first(df, mean)


def _first(df, mean):
    from pyspark.ml.functions import vector_to_array

    return df.withColumn("predicted", F.lit(mean) + F.get(vector_to_array("features"), F.lit(0)) / 2)


@pytest.fixture(scope="module")
def split(spark):
    rng = np.random.default_rng(3)
    rows = [(k, k % 4 + 1, float(rng.normal()), float(rng.integers(0, 5)), float(rng.normal() * 3)) for k in range(120)]
    return spark.createDataFrame(rows, "sample_id long, fold int, a double, b double, target double").cache()


@pytest.mark.parametrize("sent", [True, False])
def test_a_fake_estimator_is_fitted_once_and_scored_by_hand(split, sent):
    runner = FakeRunner(sent)
    out = estimators.estimator_evidence(split, ["a", "b"], {"both_but_one": ("a",)}, {"fake": runner}, 3).collect()
    # one fit for each fold and set: full, two alone, two removals and the group; none for a permutation
    assert len(runner.fits) == 4 * 6
    rows = split.toPandas()
    got = {(r.experiment, r.target, r.fold, r.repetition): r for r in out}
    for fold in range(1, 5):
        held, mean = rows[rows.fold == fold], rows[rows.fold != fold].target.mean()
        error = lambda first: float(np.abs(mean + np.asarray(first) / 2 - held.target).mean())  # noqa: E731, B023
        full = error(held.a)
        assert got["isolated", "b", fold, None].result == pytest.approx(error(held.b)) and got["isolated", "b", fold, None].reference is None
        assert got["removal", "a", fold, None].result == pytest.approx(error(held.b)) and got["removal", "a", fold, None].reference == pytest.approx(full)
        assert got["removal", "b", fold, None].delta == pytest.approx(0)
        order = lambda seed: sorted(range(len(held)), key=lambda i: (hashlib.sha256(f"{seed}:{held.sample_id.iloc[i]}".encode()).hexdigest(), held.sample_id.iloc[i]))  # noqa: E731, B023
        for rep in range(3):
            seed = int(hashlib.sha256(f"42:{fold}:a:{rep}".encode()).hexdigest()[:8], 16)
            given = np.empty(len(held))
            given[order(0)] = held.a.to_numpy()[order(seed)]
            assert got["permutation", "a", fold, rep].result == pytest.approx(error(given)) and got["permutation", "a", fold, rep].seed == seed
            assert got["permutation", "b", fold, rep].delta == pytest.approx(0)
    pooled = [r for r in out if r.scope == "oof" and r.experiment == "permutation" and r.target == "a"]
    assert len(pooled) == 3 and all(r.n == 120 for r in pooled)


def test_no_rows_and_unknown_experiments(split):
    assert estimators.estimator_evidence(split.where("false"), ["a"], {}, {"fake": FakeRunner(True)}, 2).count() == 0
    with pytest.raises(ValueError, match="'guess'"):
        estimators.estimator_evidence(split, ["a"], {}, {}, experiments=("guess",))


def test_trees_in_tasks_predict_what_the_model_predicts(spark, split):
    runner = estimators.forest_runner({"numTrees": 7, "maxDepth": 6})
    fitted, transform = runner.fit(split, ["a", "b"], "target")
    want = {r.sample_id: r.predicted for r in transform(estimators.models.assemble(split, ["a", "b"])).collect()}
    rows = split.toPandas()
    assert fitted.predict(rows[["a", "b"]].to_numpy()).tolist() == pytest.approx([want[k] for k in rows.sample_id])
    assert estimators.trees_of(estimators.models.forest({"numTrees": 3}, "target").fit(estimators.models.assemble(split, ["a"])), spark, 10) is None


def test_resamples_by_plain_loops(spark, monkeypatch):
    values = {k: float((k * 31) % 17) - 6 for k in range(40)}
    frame = spark.createDataFrame([*values.items()], "sample_id long, v double").repartition(3)

    def scrambled(t):
        for _ in range(2):
            t = ((t ^ (t >> 16)) * 0x45D9F3B) & 0xFFFFFFFF
        return t ^ (t >> 16)

    def weight(key, rep):
        row, own = hashlib.sha256(f"5:{key}".encode()).digest(), hashlib.sha256(f"5:{rep}:draw".encode()).digest()
        high, low, rhigh, rlow = (int.from_bytes(x, "big") for x in (row[:4], row[4:8], own[:4], own[4:8]))
        u, k, p = scrambled(scrambled(low ^ rlow) ^ high ^ rhigh) / 2**32, 0, math.exp(-1)
        total = p
        while u >= total and k < 12:
            k += 1
            p /= k
            total += p
        return k

    for cells in (1 << 20, 60):
        monkeypatch.setattr(metrics, "DRAWN_CELLS", cells)
        got = {r.rep: r.v for r in metrics.bootstrap_draws(frame, ["v"], 50, 5).collect()}
        for rep in range(50):
            w = {k: weight(k, rep) for k in values}
            assert got[rep] == pytest.approx(sum(w[k] * v for k, v in values.items()) / sum(w.values()))


def test_changed_rows_are_named(spark):
    before = spark.createDataFrame([(k, k * 2.0, "x") for k in range(60)] + [(7, 14.0, "x")], "id long, v double, note string")
    kept = fingerprint.remember(before, "t", "id", ["id", "v"], buckets=8)
    assert fingerprint.changed_rows(kept, before.withColumn("note", F.lit("other"))).count() == 0
    rows = [(k, k * 2.0 + (k == 5), "x") for k in range(60) if k != 9] + [(100, 1.0, "x"), (100, 1.0, "x")]
    got = {(r.table, r.key, r.change) for r in fingerprint.changed_rows(kept, spark.createDataFrame(rows, before.schema)).collect()}
    assert got == {("t", "5", "changed"), ("t", "9", "removed"), ("t", "100", "added"), ("t", "7", "changed")}
    assert fingerprint.changed_rows(kept, before.where("false")).count() == 60


def test_places_are_joined_without_broadcast(spark):
    from maskwright.operators import evidence

    # a source of known, small size, which the planner would broadcast
    split = spark.range(40).selectExpr("id AS sample_id", "CAST(id % 2 + 1 AS INT) AS fold", "CAST(id AS DOUBLE) AS a")
    rows = evidence.permuted_values(split, ["a"], 2, 42, 40, 2)
    assert rows.count() == 80
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_fold_models_end_with_their_fold(spark):
    from maskwright.operators import models

    rows = models.assemble(spark.createDataFrame([(i, i % 2 + 1, float(i), float(i)) for i in range(40)], "sample_id long, fold int, a double, target double"), ["a"])
    estimator = models.forest({"numTrees": 3})
    assert estimator.getCacheNodeIds()
    scored = models.oof_model(rows, estimator, both_roles=True)
    assert scored.count() == 80 and scored.where("role = 'validation'").select("sample_id").distinct().count() == 40
    # stored scores are read back: no tree is part of the plan, and running it again fits and scores nothing
    assert all("maskwright" in f for f in scored.inputFiles()) and scored.inputFiles()
