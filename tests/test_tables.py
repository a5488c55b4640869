import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import best_epoch, effect_class, half_even, half_up, permutation_seed, significant
from maskwright.operators import checks, diagnostics, evidence, fingerprint, metrics, predict, ranks, redundancy, split
from maskwright.session import materialize
from maskwright.sources import files


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([(f"f{i:03d}", "AB"[i % 2], float(i)) for i in range(1, 133)], "sample_id string, grp string, target double")


@pytest.mark.parametrize("k, sizes", [(4, {33}), (8, {16, 17}), (10, {13, 14})])
def test_quantile_sizes(targets, k, sizes):
    counts = split.quantile_category(targets, k).groupBy("category_no").count().collect()
    assert {r["count"] for r in counts} == sizes and len(counts) == k


@pytest.mark.parametrize("rows_per_task", [2_000_000, 40, 7])
def test_split_does_not_depend_on_task_size(targets, rows_per_task):
    got = split.stratified_split(targets, 10, 5, rows_per_task=rows_per_task)
    base = split.stratified_split(targets, 10, 5)
    assert sorted(map(tuple, got.select("sample_id", "category", "fold").collect())) == sorted(map(tuple, base.select("sample_id", "category", "fold").collect()))
    assert checks.split_balance(got, 10, 5).count() == 0
    assert sorted(r["count"] for r in got.groupBy("fold").count().collect()) == [26, 26, 26, 27, 27]


def test_ties_and_hot_values_keep_exact_ranks(spark):
    df = spark.createDataFrame([(i, 5.0 if i % 3 else float(i)) for i in range(300)], "sample_id long, target double")
    got = {r["sample_id"]: r["position"] for r in split.global_position(df, ["target", "sample_id"], 300, 40).collect()}
    order = sorted(range(300), key=lambda i: (5.0 if i % 3 else float(i), i))
    assert got == {i: p for p, i in enumerate(order)}


def test_nested_subsets(targets):
    rows = split.stratified_split(targets, 10, 5)
    got = split.nested_subsets(rows, n=132).select("outer_fold", "fraction", "sample_id", "fold").collect()
    for fold in range(1, 6):
        sets = {f: {r["sample_id"] for r in got if r["outer_fold"] == fold and r["fraction"] == f} for f in (0.5, 0.75, 1.0)}
        assert sets[0.5] < sets[0.75] < sets[1.0]
        n = len(sets[1.0])
        assert (len(sets[0.5]), len(sets[0.75])) == (round(n * 0.5), round(n * 0.75))
    assert all(r["fold"] != r["outer_fold"] for r in got)


def test_pooled_metrics_fixture(spark):
    rows = [("B1", 1, 10.0, 12.0), ("B1", 2, 20.0, 18.0), ("B10", 1, 30.0, 31.0), ("B10", 2, 40.0, 35.0)]
    df = spark.createDataFrame([("m", "a", "candidate", i, *r) for i, r in enumerate(rows)], "configuration string, approach string, role string, sample_id int, category string, fold int, observed double, predicted double")
    got = {(r["scope"], r["fold"], r["population"]): r for r in metrics.fold_and_pooled(df).collect()}
    pooled = got["oof", None, "all"]
    assert (pooled["n"], pooled["mae"], pooled["bias"]) == (4, 2.5, -1)
    assert pooled["rmse"] == pytest.approx(2.915475947) and pooled["r2"] == pytest.approx(0.932)
    assert (got["oof", None, "B1"]["mae"], got["oof", None, "B1"]["bias"]) == (2, 0)
    assert (got["oof", None, "B10"]["mae"], got["oof", None, "B10"]["bias"], got["oof", None, "B10"]["r2"]) == (3, -2, None)


def predictions(spark, rows):
    return spark.createDataFrame(rows, "configuration string, role string, sample_id int, category string, grp string, resolution string, observed double, predicted double")


def test_shared_hard_case_and_ties(spark):
    names = ["a", "b", "c", "d"]
    rows = [(m, "baseline", i, "B1", "g", "r", 100.0, 200.0 if i == 0 and m != "d" else 101.0) for m in names for i in range(20)]
    got = diagnostics.notable_cases(predictions(spark, rows), names).where("case_type = 'shared_hard_case'").collect()
    assert 0 in {r["sample_id"] for r in got}
    tied = [(m, "baseline", i, "B1", "g", "r", 100.0, 150.0 if i < 2 else 101.0 + i / 10) for m in names for i in range(10)]
    got = diagnostics.notable_cases(predictions(spark, tied), names).where("case_type = 'shared_hard_case'").collect()
    assert {r["sample_id"] for r in got} == {0, 1}


def test_thin_resolutions_and_group_scopes(spark):
    rows = [("m", "baseline", i, "B1", "g", "big" if i < 12 else "small", 100.0, 101.0) for i in range(17)]
    got = diagnostics.stratified(predictions(spark, rows)).where("stratum_type = 'resolution'").collect()
    assert [r["stratum_value"] for r in got] == ["big"]
    rows = [("m", "baseline", i, "B1", g, "r", t, t + 5) for i, (g, t) in enumerate([("A", 80.0), ("A", 100.0), ("B", 200.0), ("B", 350.0)])]
    got = {(r["sample_scope"], r["grp"]): r for r in diagnostics.group_comparison(predictions(spark, rows), 92, 265).collect()}
    assert (got["shared_range", "A"]["sample_count"], got["shared_range", "A"]["mae"]) == (1, 5)


def test_residual_correlation_and_zero_variance(spark):
    rows = [(m, "baseline", i, "B1", "g", "r", 0.0, v) for m, vs in {"x": (10.0, -10.0), "y": (5.0, -5.0), "z": (3.0, 3.0)}.items() for i, v in enumerate(vs)]
    got = {(r["configuration_1"], r["configuration_2"]): r["pearson"] for r in diagnostics.residual_correlations(predictions(spark, rows), ["x", "y", "z"]).collect()}
    assert got["x", "y"] == pytest.approx(1) and got["z", "z"] == 1 and got["x", "z"] == 0 and len(got) == 9


def test_scalar_rules(spark):
    df = spark.createDataFrame([(-1.0,), (1.0,), (-1.000001,), (1.000001,), (None,)], "d double")
    assert [r[0] for r in df.select(effect_class(F.col("d"))).collect()] == ["neutral", "neutral", "improvement", "harm", None]
    row = spark.range(1).select(half_up(F.lit(2.5)).alias("a"), half_up(F.lit(-2.5)).alias("b"), half_even(F.lit(2.5)).alias("c"), half_even(F.lit(3.5)).alias("d"),
                                permutation_seed(42, F.lit(1), F.lit("area"), F.lit(0)).alias("s")).first()
    assert tuple(row) == (3, -2, 2.0, 4.0, 3709114571)
    values = [0.1 + 0.2, 1234567.891234567, 1e-7 / 3, 1.5e15, -2.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(significant(F.col("v"))).collect()]
    assert got == [f"{v:.12g}" for v in values]


def test_best_epoch_walk(spark):
    df = spark.createDataFrame([([10.0, 9.0, 8.95, 8.5, 8.45, 8.42, 8.41, 1.0],), ([5.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(best_epoch(F.col("v"), 0.1, 3)).collect()] == [4, 1, 1]


def test_recommendation_rules(spark):
    cases = {"a": (-1.2, 0.8), "b": (-1.2, 1.1), "c": (-1.0, 0.2)}
    rows = [("removal", b, t, "oof", d) for t, ds in cases.items() for b, d in zip(("ordinary", "ridge"), ds)]
    df = spark.createDataFrame(rows, "experiment string, baseline string, target string, scope string, delta double")
    got = {r["target"]: r["recommendation"] for r in evidence.recommendations(df, ["ordinary", "ridge"]).collect()}
    assert got == {"a": "recommend_removal", "b": "retain_harm_veto", "c": "retain_double_neutral"}


def test_permuted_values_keep_each_fold_intact(spark, targets):
    rows = split.stratified_split(targets, 10, 5).withColumn("x", F.col("target") * 2)
    got = evidence.permuted_values(rows, ["x"], 2, 42, 132, rows_per_task=5).select("fold", "repetition", "x", "given").collect()
    for fold in range(1, 6):
        for rep in range(2):
            part = [r for r in got if (r["fold"], r["repetition"]) == (fold, rep)]
            assert sorted(r["x"] for r in part) == sorted(r["given"] for r in part)
            assert [r["x"] for r in part] != [r["given"] for r in part]


def test_redundancy_of_bijections(spark):
    df = spark.createDataFrame([(i, float(v), v**0.5, 1.0) for i, v in enumerate((1, 4, 9, 16))], "id int, area double, equivalent_diameter double, extent double")
    got = {(r["feature_a"], r["feature_b"]): r for r in redundancy.redundancy(df, "id", ["area", "equivalent_diameter", "extent"]).collect()}
    pair = got["area", "equivalent_diameter"]
    assert pair["spearman"] == pytest.approx(1) and pair["structural_relation"] == "area_bijection" and pair["removal_group"] == "area_transformations"
    assert got["area", "extent"]["pearson"] is None


@pytest.mark.parametrize("heavy", [0.001, 0.2, 1.0])
def test_average_ranks_with_ties(spark, monkeypatch, heavy):
    monkeypatch.setattr(ranks, "HEAVY_SHARE", heavy)
    values = [3, 1, 3, 2, 3, 9, 2, 7, 3, 3, 3, 8, 3, 3] * 3
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, v double")
    got = {r["id"]: r["rank"] for r in ranks.average_ranks(ranks.melt(df, "id", ["v"]), len(values)).collect()}
    for i, v in enumerate(values):
        assert got[i] == sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2


def test_p_values():
    # reference values of the two-sided t test: r = 0.5, n = 20 and r = 0.1, n = 100
    assert ranks._correlation_p(0.5, 20) == pytest.approx(0.0248, abs=5e-4)
    assert ranks._correlation_p(0.1, 100) == pytest.approx(0.3222, abs=5e-4)
    assert ranks._correlation_p(0.0, 50) == pytest.approx(1, abs=1e-6)


def test_fingerprint_ignores_order_and_unselected_columns(spark):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b"), (2, None, "b")], "k int, v double, note string")

    def digest(x):
        return fingerprint.table_fingerprint(x, "t", ["k", "v"]).first()["digest"]

    assert digest(df) == digest(df.orderBy(F.desc("k"))) == digest(df.withColumn("note", F.lit("z")))
    assert digest(df) != digest(df.distinct()) and digest(df) != digest(df.withColumn("v", F.col("v") + 1))


def test_header_must_match_exactly(spark, tmp_path):
    spark.createDataFrame([("a.png", "x", 1.0)], "file_name string, weight_kg string, farm double").coalesce(1).write.option("header", True).csv(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="expected"):
        files.read_index(spark, str(tmp_path / "t"))


def test_mismatching_ids_are_an_error(spark):
    a = spark.createDataFrame([("x",), ("y",)], "id string")
    with pytest.raises(ValueError, match="missing"):
        files.feature_samples(a.where("id = 'x'").withColumn("f", F.lit(1)), a, "id")


def test_bootstrap_of_a_clear_winner(spark):
    df = spark.createDataFrame([(i, -10.0) for i in range(20)], "sample_id int, d double")
    got = metrics.bootstrap_interval(df, "d", 50).first()
    assert (got["point"], got["ci_low"], got["ci_high"], got["probability_below_zero"]) == (-10, -10, -10, 1)


def test_percentiles_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = {"a": rng.normal(0, 5, 12_001), "b": np.where(rng.random(30_000) < 0.4, 7.0, rng.random(30_000) * 20), "c": rng.random(12), None: rng.random(501), "one": [4.0]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs], "g string, v double")
    got = {r["g"]: r for r in ranks.group_percentiles(df, ["g"], "v", {"p50": 0.5, "p90": 0.9, "top": 1.0}).collect()}
    for g, vs in values.items():
        assert [got[g][k] for k in ("p50", "p90", "top")] == pytest.approx(np.quantile(vs, [0.5, 0.9, 1.0]), rel=1e-12)


def test_null_groups_keep_their_percentiles(spark):
    rows = [("c", None, 1.0, 2.0), ("c", None, 1.0, 5.0), ("c", "x", 1.0, 1.5), ("c", "empty", None, 1.0)]
    df = spark.createDataFrame(rows, "configuration string, grp string, observed double, predicted double")
    got = {r["grp"]: (r["n"], r["median_ae"]) for r in metrics.summarize_extended(df, "configuration", "grp").collect()}
    assert got == {None: (2, 2.5), "x": (1, 0.5), "empty": (1, None)}


def test_lines_far_from_zero(spark):
    rows = [(i, i % 5 + 1, None if i % 3 == 0 else "g", 1e9 + i, 3 * (1e9 + i) - 7) for i in range(200)]
    df = spark.createDataFrame(rows, "sample_id int, fold int, grp string, x double, target double").withColumns({"resolution": F.lit("r"), "category": F.lit("B1")})
    assert all(r["slope_x"] == pytest.approx(3.0, abs=1e-9) for r in predict.fold_lines(df, ["x"]).collect())
    got = predict.oof_predictions(df, ["x"]).where("configuration = 'line_x'").collect()
    assert len(got) == 200 and all(r["predicted"] == pytest.approx(r["observed"], abs=1e-3) for r in got)
    scaled = predict.standardize(df, ["x"]).collect()
    assert {round(r["sd_x"], 6) for r in scaled} and all(abs(r["sd_x"] - 57.73) < 1.5 for r in scaled)


def test_samples_are_never_the_broadcast_side_of_their_models(spark, monkeypatch):
    rows = spark.range(200).selectExpr(
        "id AS sample_id", "IF(id % 3 = 0, NULL, concat('g', id % 3)) AS grp", "'r' AS resolution", "'B1' AS category", "cast(id % 5 + 1 AS int) AS fold",
        "cast(id * 2 AS double) AS target", "cast(id * id % 17 AS double) AS x",
    )
    stored, _ = materialize(rows)
    plan = predict.oof_predictions(stored, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan  # else the side that looks smaller at run time is, and that can be the samples
    key = lambda r: (r["sample_id"], r["configuration"])
    want = sorted(predict.oof_predictions(stored, ["x"]).collect(), key=key)
    monkeypatch.setattr(predict, "BROADCAST_MODELS", 0)
    got = predict.oof_predictions(stored, ["x"])
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.collect(), key=key) == want and len(want) == 600


def test_digests_of_files_above_one_task(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    contents = {
        "a b%20.bin": fingerprint.BYTE_ORDER_MARK + rng.randbytes(300_000), "b.bin": fingerprint.BYTE_ORDER_MARK + rng.randbytes(200_000) + b"\n", "c.bin": rng.randbytes(300_001) + b"\n",
        "crlf.txt": b"ab\r\n\r\r\n" * 30_000, "feeds": b"\n" * 150_000, "zeros": bytes(200_000), "d.gz": gzip.compress(rng.randbytes(100_000)), "small.bin": b"\xff\n", "edge": rng.randbytes(50_000),
    }
    (tmp_path / "below").mkdir()
    for k, (name, raw) in enumerate(contents.items()):
        (tmp_path / ("below" if k % 2 else ".") / name).write_bytes(raw)
    split_bytes = spark.conf.get("spark.sql.files.maxPartitionBytes")
    read = []
    monkeypatch.setattr(fingerprint, "_large_digests", lambda large, n, *rest, f=fingerprint._large_digests: read.append(n) or f(large, n, *rest))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = fingerprint.file_digests(files.list_files(spark, str(tmp_path)), files.file_lines(spark, str(tmp_path)), 50_000).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    assert sorted(map(tuple, got)) == sorted((n, hashlib.sha256(raw).hexdigest(), len(raw)) for n, raw in contents.items())
    assert read == [6]
