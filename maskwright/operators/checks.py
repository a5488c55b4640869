"""Constraint checks: each returns its violations as rows, and an empty table means it passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import effect_class, finite, permutation_seed


def row_count(df: DataFrame, expected: int) -> DataFrame:
    return df.agg(F.count("*").alias("actual")).select(F.lit(expected).cast("long").alias("expected"), "actual").where("actual != expected")


def value_domains(index: DataFrame) -> DataFrame:
    """Base names ending in .png, non-empty groups, finite targets above zero; one row per broken rule."""
    broken = F.filter(
        F.array(
            F.when(~F.coalesce(F.col("file_name").rlike(r"^[^/\\]+\.png$"), F.lit(False)), "file_name"),
            F.when(F.length(F.trim(F.coalesce("grp", F.lit("")))) == 0, "grp"),
            F.when(~(finite(F.col("target")) & (F.col("target") > 0)), "target"),
        ),
        lambda c: c.isNotNull(),
    )
    return index.select("file_name", "grp", "target", F.explode(broken).alias("rule"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_and_extra(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, labelled `missing` (not in actual) or `extra` (not in expected)."""
    missing = expected.select(key).join(actual, key, "left_anti").withColumn("problem", F.lit("missing"))
    extra = actual.select(key).join(expected, key, "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def pixel_values(gray: DataFrame, allowed: tuple[int, ...] = (0, 255)) -> DataFrame:
    """Masks with cell values outside the allowed set; `gray` has an array column `values`."""
    other = F.array_except(F.array_distinct("values"), F.array(*[F.lit(v) for v in allowed]))
    found = gray.select("mask_id", F.sort_array(other).alias("other"))
    return found.where(F.size("other") > 0).select("mask_id", F.slice("other", 1, 10).alias("preview"))


def exact_columns(df: DataFrame, expected: list[str], prefix_only: bool = False) -> DataFrame:
    """Positions at which the header differs from the contract."""
    actual = df.columns
    width = len(expected) if prefix_only else max(len(expected), len(actual))
    rows = [
        (i, expected[i] if i < len(expected) else None, actual[i] if i < len(actual) else None)
        for i in range(width)
    ]
    differing = [r for r in rows if r[1] != r[2]]
    return df.sparkSession.createDataFrame(differing, "position int, expected string, actual string")


def required_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [(c,) for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame(missing, "missing string")


def split_balance(split: DataFrame, k: int, folds: int) -> DataFrame:
    """Category, fold and fold-within-category sizes outside floor and ceiling of an equal share.

    Works on the fold x category counts; cells that no row falls into count as zero.
    """
    cells = split.groupBy("fold", "category").agg(F.count("*").alias("n"))
    every_fold = F.sequence(F.lit(1), F.lit(folds))
    grid = _full_grid(cells, every_fold)
    return _unbalanced(grid, k, folds)


def _full_grid(cells: DataFrame, every_fold: Column) -> DataFrame:
    grid = cells.select("category").distinct().withColumn("fold", F.explode(every_fold))
    return grid.join(cells, ["category", "fold"], "left").fillna(0, ["n"])


def _unbalanced(grid: DataFrame, k: int, folds: int) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    in_category = F.sum("n").over(Window.partitionBy("category"))
    in_fold = F.sum("n").over(Window.partitionBy("fold"))
    sized = grid.select("category", "fold", "n", total.alias("t"), in_category.alias("c"), in_fold.alias("f"))

    def row(scope: str, fold: Column, category: Column, n: Column, whole: Column, parts: int) -> Column:
        share = whole / F.lit(float(parts))
        return F.struct(
            F.lit(scope).alias("scope"), fold.cast("long").alias("fold"), category.cast("string").alias("category"),
            n.cast("long").alias("n"), F.floor(share).cast("long").alias("low"), F.ceil(share).cast("long").alias("high"),
        )

    none = F.lit(None)
    rows = F.array(
        row("category", none, F.col("category"), F.col("c"), F.col("t"), k),
        row("fold", F.col("fold"), none, F.col("f"), F.col("t"), folds),
        row("cell", F.col("fold"), F.col("category"), F.col("n"), F.col("c"), folds),
    )
    return sized.select(F.inline(rows)).distinct().where("n < low OR n > high")


def prediction_coverage(predictions: DataFrame, ids: DataFrame, key: str = "sample_id") -> DataFrame:
    """(configuration, key) pairs that are not predicted exactly once, absent ones with n = 0."""
    counted = predictions.groupBy("configuration", key).agg(F.count("*").alias("n"))
    # a handful of configuration names, expanded onto the ids without a join
    names = predictions.select("configuration").distinct().agg(F.sort_array(F.collect_set("configuration")).alias("c"))
    expected = (
        ids.select(key).withColumn("_k", F.lit(0))
        .join(F.broadcast(names.withColumn("_k", F.lit(0))), "_k")
        .select(key, F.explode("c").alias("configuration"))
    )
    both = expected.withColumn("_expected", F.lit(True)).join(counted, ["configuration", key], "full_outer")
    return both.select("configuration", key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("_expected", F.lit(False)).alias("known")).where(
        "n != 1 OR NOT known"
    )


def identity_differences(predictions: DataFrame, split: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows whose category, fold or observed value is not the one of the canonical split."""
    truth = split.select(key, F.col("category").alias("c"), F.col("fold").alias("f"), F.col("target").alias("t"))
    joined = predictions.join(truth, key, "left")
    same = F.col("category").eqNullSafe(F.col("c")) & F.col("fold").eqNullSafe(F.col("f")) & F.col("observed").eqNullSafe(F.col("t"))
    return joined.where(~same).select("configuration", key, "category", "fold", "observed", F.col("c").alias("expected_category"), F.col("f").alias("expected_fold"), F.col("t").alias("expected_observed"))


def non_finite(df: DataFrame, *columns: str) -> DataFrame:
    ok = F.lit(True)
    for c in columns:
        ok = ok & finite(F.col(c))
    return df.where(~ok)


def key_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Missing, extra and duplicate keys of a table against its expected key grid."""
    columns = expected.columns
    both = (
        expected.withColumn("_e", F.lit(1)).withColumn("_a", F.lit(0))
        .unionByName(actual.select(*columns).withColumn("_e", F.lit(0)).withColumn("_a", F.lit(1)))
        .groupBy(*columns)
        .agg(F.sum("_e").alias("_e"), F.sum("_a").alias("n_actual"))
    )
    problem = (
        F.when(F.col("n_actual") == 0, "missing").when(F.col("_e") == 0, "extra").when(F.col("n_actual") > 1, "duplicate")
    )
    return both.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(*columns, "n_actual", "problem")


def evidence_arithmetic(evidence: DataFrame, fold_sizes: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Wrong n, wrong delta or an effect that does not follow from the delta."""
    total = fold_sizes.agg(F.sum("size").alias("size")).select(F.lit(None).cast("int").alias("fold"), "size")
    sizes = fold_sizes.select(F.col("fold").cast("int").alias("fold"), "size").unionByName(total).select(F.col("fold").alias("_f"), "size")
    joined = evidence.join(F.broadcast(sizes), F.col("fold").eqNullSafe(F.col("_f")), "left")
    isolated = F.col("experiment") == "isolated"
    wrong_delta = F.abs(F.col("delta") - (F.col("result") - F.col("reference"))) > tolerance
    wrong_effect = ~F.col("effect").eqNullSafe(effect_class(F.col("delta")))
    nulls_wrong = F.when(isolated, F.col("delta").isNotNull() | F.col("reference").isNotNull() | F.col("effect").isNotNull()).otherwise(
        F.col("delta").isNull() | F.col("reference").isNull()
    )
    problem = (
        F.when(~F.col("n").eqNullSafe(F.col("size")), "n").when(nulls_wrong, "nullability")
        .when(wrong_delta, "delta").when(wrong_effect, "effect")
    )
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull()).drop("_f", "size")


def evidence_seeds(evidence: DataFrame, split_seed: int = 42) -> DataFrame:
    """Permutation rows whose seed is not the derived one; pooled and other rows carry none."""
    derived = F.when(
        (F.col("experiment") == "permutation") & (F.col("scope") == "fold"),
        permutation_seed(split_seed, F.col("fold"), F.col("target"), F.col("repetition")),
    )
    return evidence.withColumn("expected_seed", derived).where(~F.col("seed").eqNullSafe(F.col("expected_seed")))


def redundancy_rows(redundancy: DataFrame, features: list[str], relations: list[str], groups: list[str]) -> DataFrame:
    """Pairs outside the ordered feature grid, unknown labels, and correlations outside [-1, 1]."""
    order = F.array(*[F.lit(f) for f in features])
    place_a, place_b = F.array_position(order, F.col("feature_a")), F.array_position(order, F.col("feature_b"))
    parts = F.split("structural_relation", r"\|")
    known = F.array(*[F.lit(r) for r in relations])
    relation_ok = (F.col("structural_relation") == "none") | (F.size(F.array_except(parts, known)) == 0)

    def correlation_bad(name: str) -> Column:
        c = F.col(name)
        return c.isNotNull() & (F.isnan(c) | (F.abs(c) > 1 + 1e-12))

    problem = (
        F.when((place_a == 0) | (place_b == 0) | (place_a >= place_b), "pair")
        .when(~relation_ok, "relation")
        .when(~F.col("removal_group").isin([*groups, "none"]), "removal_group")
        .when(correlation_bad("pearson") | correlation_bad("spearman"), "correlation")
    )
    return redundancy.withColumn("problem", problem).where(F.col("problem").isNotNull())


def six_decimals(df: DataFrame, column: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).rlike(r"^-?\d+\.\d{6}$"), F.lit(False)))


def out_of_order(df: DataFrame, ordinal: str, key: list[Column], partition: str) -> DataFrame:
    """Rows whose key sorts before that of the previous row of the file, by explicit ordinal."""
    previous = F.lag(F.struct(*key)).over(Window.partitionBy(partition).orderBy(ordinal))
    return df.withColumn("_now", F.struct(*key)).withColumn("_prev", previous).where(F.col("_now") < F.col("_prev")).drop("_now", "_prev")


def metric_differences(stored: DataFrame, recomputed: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Metric rows that are absent on one side or differ by more than the tolerance."""
    right = recomputed.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_r"))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = stored.withColumn("_l", F.lit(True)).join(right, condition, "full_outer")
    differs = F.lit(False)
    for v in values:
        differs = differs | F.coalesce(F.abs(F.col(v) - F.col(f"_{v}")) > tolerance, F.col(v).isNull() != F.col(f"_{v}").isNull())
    problem = F.when(F.col("_l").isNull(), "missing").when(F.col("_r").isNull(), "extra").when(differs, "value")
    return joined.select(
        *[F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in keys], problem.alias("problem")
    ).where(F.col("problem").isNotNull())


def residual_arithmetic(predictions: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    r = F.col("predicted") - F.col("observed")
    return predictions.where((F.abs(F.col("residual") - r) > tolerance) | (F.abs(F.col("absolute_error") - F.abs(r)) > tolerance))


def fold_isolation(membership: DataFrame, key: str = "sample_id") -> DataFrame:
    """Held-out keys that also take part in selection, stopping or refit of the same fold."""
    held = membership.where("role = 'held_out'").select("outer_fold", key)
    return membership.where("role != 'held_out'").join(held, ["outer_fold", key], "left_semi")


def partition_arithmetic(membership: DataFrame, n: int) -> DataFrame:
    """Folds in which selection + stopping != refit, refit + held out != n, or a part is empty."""
    parts = [F.count(F.when(F.col("role") == r, 1)).alias(r) for r in ("selection", "stopping", "refit", "held_out")]
    return membership.groupBy("outer_fold").agg(*parts).where(
        f"selection + stopping != refit OR refit + held_out != {n} OR least(selection, stopping, refit, held_out) <= 0"
    )


def several_files_per_stem(files: DataFrame) -> DataFrame:
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return files.groupBy(stem.alias("stem")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("names")).where("n > 1")


def single_identity(predictions: DataFrame, *scope: str) -> DataFrame:
    """Groups that mix several (configuration, approach, role) identities."""
    counted = predictions.groupBy(*scope).agg(F.count_distinct("configuration", "approach", "role").alias("n_identities"))
    return counted.where("n_identities != 1")


def missing_configurations(predictions: DataFrame, required: list[str]) -> DataFrame:
    wanted = predictions.sparkSession.createDataFrame([(c,) for c in required], "configuration string")
    return wanted.join(predictions, "configuration", "left_anti")


def feature_selection_order(selected: DataFrame, candidates: list[str]) -> DataFrame:
    """Selected features (place, feature) that are unknown, repeated or out of candidate order."""
    order = F.array(*[F.lit(c) for c in candidates])
    placed = selected.withColumn("_o", F.array_position(order, F.col("feature")))
    # a list of at most as many rows as there are candidate features
    w = Window.partitionBy(F.lit(0)).orderBy("place")
    previous = F.max("_o").over(w.rowsBetween(Window.unboundedPreceding, -1))
    repeated = F.count("*").over(Window.partitionBy("feature")) > 1
    problem = F.when(F.col("_o") == 0, "unknown").when(repeated, "repeated").when(F.col("_o") < previous, "order")
    return placed.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("place", "feature", "problem")


def canonical_package(coverage: DataFrame, stratified: DataFrame, correlations: DataFrame, notable: DataFrame, learning: DataFrame, sensitivity: DataFrame, expected_samples: int) -> DataFrame:
    """Cross-table checks of the six public diagnostic tables, one row per broken rule."""

    def verdict(name: str, df: DataFrame, value: Column, bad: Column) -> DataFrame:
        return df.agg(value.cast("string").alias("value"), F.coalesce(bad, F.lit(True)).alias("bad")).where("bad").select(F.lit(name).alias("rule"), "value")

    total = F.sum(F.when(F.col("stratum_type") == "category", F.col("sample_count")).otherwise(0))
    not_in = lambda c, ok: F.count(F.when(~F.col(c).isin(ok), 1))
    checks_ = [
        verdict("coverage_total", coverage, total, total != expected_samples),
        verdict("stratified_not_empty", stratified, F.count("mae"), F.count("mae") == 0),
        verdict("correlations_not_empty", correlations, F.count("*"), F.count("*") == 0),
        verdict("case_types", notable, not_in("case_type", ["shared_hard_case", "divergent_case"]), not_in("case_type", ["shared_hard_case", "divergent_case"]) > 0),
        verdict("learning_not_empty", learning, F.count("*"), F.count("*") == 0),
        verdict("sensitivity_status", sensitivity, not_in("status", ["eligible", "rejected"]), not_in("status", ["eligible", "rejected"]) > 0),
    ]
    out = checks_[0]
    for c in checks_[1:]:
        out = out.unionByName(c)
    return out


def duplicate_content(digests: DataFrame, digest: str = "digest", key: str = "mask_id") -> DataFrame:
    """Contents shared by several keys, with how many and the smallest key."""
    return digests.groupBy(digest).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).where("n > 1")
