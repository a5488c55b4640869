"""Queries: out-of-fold predictions, their metrics and the diagnostics built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import r6
from maskwright.operators import diagnostics, metrics, predict, split
from maskwright.plans.common import LINE_FEATURES, candidates, orders_split, predictions, samples_split
from maskwright.plans.oracle import fragment, q, r6 as sql_r6
from maskwright.plans.registry import query
from maskwright.session import materialize
from maskwright.sources import tables

CANDIDATES = ["group_mean", "line_words", "line_lines", "line_digits"]
D = 4  # decimals compared


def rounded(df, *names, digits=D):
    return df.select(*[r6(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])


def longs(df, *names):
    return df.select(*[F.col(c).cast("long").alias(c) if c in names else F.col(c) for c in df.columns])


def prediction_rows(spark, sf):
    """Rows of the prediction table, from the row count in the file footers."""
    return (len(CANDIDATES) + 1) * tables.table(spark, sf, "documents").count()


RES = "(predicted - observed)"
FULL = ", ".join([
    "count(*) AS n", sql_r6(f"avg(abs({RES}))", "mae", D), sql_r6(f"sqrt(avg({RES} * {RES}))", "rmse", D), sql_r6(f"avg({RES})", "bias", D),
    sql_r6(f"1 - sum({RES} * {RES}) / nullif(var_pop(observed) * count(*), 0)", "r2", D),
])
fragment("c_pred", "SELECT * FROM s_pred WHERE role = 'candidate'")


@query("training_mean_reference", q("SELECT sample_id, CAST(fold AS BIGINT) AS fold, category, target AS observed, " + sql_r6(
    "(SELECT avg(t.target) FROM o_split t WHERE t.fold <> o.fold)", "predicted", D) + " FROM o_split o"))
def training_mean_reference(spark, sf):
    rows = predict.training_mean(orders_split(spark, sf))
    return rows.select("sample_id", F.col("fold").cast("long").alias("fold"), "category", F.col("target").alias("observed"), r6(F.col("predicted"), D).alias("predicted"))


@query("oof_predictions", q("SELECT configuration, approach, role, sample_id, category, CAST(fold AS BIGINT) AS fold, observed, " + sql_r6("predicted", "predicted", D) + " FROM s_pred"))
def oof_predictions(spark, sf):
    rows = rounded(longs(predictions(spark, sf), "fold"), "predicted")
    return rows.select("configuration", "approach", "role", "sample_id", "category", "fold", "observed", "predicted")


@query("isolated_feature_predictions", q("""
SELECT feature, CAST(fold AS BIGINT) AS fold, count(*) AS n, """ + sql_r6("avg(abs(predicted - target))", "mae", D) + """ FROM (
  SELECT s.fold, s.target, u.feature, u.predicted FROM s_wide s,
  LATERAL (SELECT unnest([{'feature': 'words', 'predicted': p_words}, {'feature': 'lines', 'predicted': p_lines}, {'feature': 'digits', 'predicted': p_digits}]) AS u))
GROUP BY ALL"""))
def isolated_feature_predictions(spark, sf):
    rows = predict.isolated_predictions(samples_split(spark, sf, tuple(LINE_FEATURES)), LINE_FEATURES)
    out = rows.groupBy("feature", F.col("fold").cast("long").alias("fold")).agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("predicted") - F.col("observed"))).alias("mae")
    )
    return rounded(out, "mae")


@query("standardized_features", q("""
SELECT sample_id, """ + ", ".join(sql_r6(f"({c} - m_{c}) / CASE WHEN d_{c} = 0 THEN 1 ELSE d_{c} END", f"z_{c}") for c in ("words", "lines", "target")) + """
FROM s_split JOIN (SELECT outer_fold AS fold, avg(words) AS m_words, stddev_pop(words) AS d_words, avg(lines) AS m_lines, stddev_pop(lines) AS d_lines,
  avg(target) AS m_target, stddev_pop(target) AS d_target FROM s_train GROUP BY outer_fold) USING (fold)"""))
def standardized_features(spark, sf):
    rows = predict.standardize(samples_split(spark, sf, ("words", "lines")), ["words", "lines", "target"])
    return rows.select("sample_id", *[r6(F.col(f"z_{c}")).alias(f"z_{c}") for c in ("words", "lines", "target")])


@query("target_scale_restore", q("SELECT sample_id, target, " + sql_r6("target", "restored", 3) + " FROM s_split"))
def target_scale_restore(spark, sf):
    rows = predict.standardize(samples_split(spark, sf), ["target"])
    return rows.select("sample_id", "target", r6(F.col("z_target") * F.col("sd_target") + F.col("mean_target"), 3).alias("restored"))


@query("prediction_metrics", q(f"SELECT configuration, role, {FULL} FROM s_pred GROUP BY configuration, role"))
def prediction_metrics(spark, sf):
    return rounded(metrics.summarize(predictions(spark, sf), "configuration", "role"), "mae", "rmse", "bias", "r2")


fragment("c_expanded", """
SELECT *, 'fold' AS scope, fold AS sfold, 'all' AS population FROM c_pred
UNION ALL SELECT *, 'oof', NULL, 'all' FROM c_pred
UNION ALL SELECT *, 'oof', NULL, category FROM c_pred WHERE category IN ('B1', 'B10')""")


@query("fold_and_pooled_metrics", q("""
SELECT configuration, approach, role, scope, CAST(sfold AS BIGINT) AS fold, population, n, mae, CASE WHEN population = 'all' THEN rmse END AS rmse, bias, CASE WHEN population = 'all' THEN r2 END AS r2
FROM (SELECT configuration, approach, role, scope, sfold, population, """ + FULL + """ FROM c_expanded GROUP BY configuration, approach, role, scope, sfold, population)"""))
def fold_and_pooled_metrics(spark, sf):
    return rounded(metrics.fold_and_pooled(candidates(spark, sf)), "mae", "rmse", "bias", "r2")


@query("population_metrics", q("SELECT configuration, CAST(fold AS BIGINT) AS fold, population, " + FULL + """ FROM (
  SELECT *, 'all' AS population FROM c_pred UNION ALL SELECT *, category FROM c_pred WHERE category IN ('B1', 'B10')) GROUP BY ALL"""))
def population_metrics(spark, sf):
    rows = metrics.population_metrics(candidates(spark, sf))
    return rounded(longs(rows, "fold"), "mae", "rmse", "bias", "r2")


EXT = FULL + ", " + sql_r6(f"quantile_cont(abs({RES}), 0.5)", "median_ae", D) + ", " + sql_r6(f"quantile_cont(abs({RES}), 0.9)", "p90_ae", D)


@query("extended_summary", q(f"SELECT configuration, {EXT} FROM c_pred GROUP BY configuration"))
def extended_summary(spark, sf):
    rows = metrics.summarize_extended(candidates(spark, sf), "configuration")
    return rounded(rows, "mae", "rmse", "bias", "r2", "median_ae", "p90_ae")


@query("grouped_summary", q(f"SELECT configuration, grp, {EXT} FROM c_pred GROUP BY configuration, grp"))
def grouped_summary(spark, sf):
    rows = metrics.summarize_extended(candidates(spark, sf), "configuration", "grp")
    return rounded(rows, "mae", "rmse", "bias", "r2", "median_ae", "p90_ae")


@query("best_of_models", q(f"""
SELECT {sql_r6('avg(e)', 'oracle_mae', D)}, {sql_r6('quantile_cont(e, 0.5)', 'oracle_median_ae', D)}, {sql_r6('quantile_cont(e, 0.9)', 'oracle_p90_ae', D)}
FROM (SELECT sample_id, min(abs({RES})) AS e FROM c_pred GROUP BY sample_id)"""))
def best_of_models(spark, sf):
    return rounded(metrics.best_of_models(candidates(spark, sf)), "oracle_mae", "oracle_median_ae", "oracle_p90_ae")


REPEATS = 10_000
_HALF = "CAST('0x' || substr(sha256({text}), {at}, 8) AS BIGINT)"


def _scrambled_sql(t: str) -> str:
    """The integer scrambling of `metrics._scrambled`; products stay below 2^63."""
    once = lambda x: f"((xor({x}, {x} >> 16) * 73244475) & 4294967295)"
    return once(t)


fragment("s_errors", f"""
SELECT sample_id, abs(p_words - target) - abs(p_lines - target) AS d, abs(p_words - target) AS e, {_HALF.format(text="'42:' || sample_id", at=1)} AS high, {_HALF.format(text="'42:' || sample_id", at=9)} AS low FROM s_wide""")
fragment("s_reps", f"SELECT rep, {_HALF.format(text=chr(39) + '42:' + chr(39) + ' || rep || ' + chr(39) + ':draw' + chr(39), at=1)} AS rhigh, {_HALF.format(text=chr(39) + '42:' + chr(39) + ' || rep || ' + chr(39) + ':draw' + chr(39), at=9)} AS rlow FROM (SELECT unnest(range(0, {REPEATS})) AS rep)")
fragment("s_drawn", f"""
SELECT rep, e, d, xor(t, t >> 16) AS t FROM (SELECT rep, e, d, {_scrambled_sql('t')} AS t FROM (SELECT rep, e, d, {_scrambled_sql('t')} AS t FROM (
  SELECT rep, e, d, xor(xor(xor(t, t >> 16), high), rhigh) AS t FROM (SELECT *, {_scrambled_sql('t')} AS t FROM (SELECT * EXCLUDE (t), {_scrambled_sql('t')} AS t FROM (
    SELECT rep, e, d, high, rhigh, xor(low, rlow) AS t FROM s_errors, s_reps)))))) AS x""".replace("SELECT *, ", "SELECT * EXCLUDE (t), "))
fragment("s_draws", f"""
SELECT rep, sum(w * e) / sum(w) AS e_draw, sum(w * d) / sum(w) AS d_draw FROM (
  SELECT rep, e, d, {' + '.join(f'CAST(t >= {b} AS INT)' for b in metrics.poisson_bounds())} AS w FROM s_drawn) GROUP BY rep""")


def _paired(spark, sf):
    rows = samples_split(spark, sf, ("words", "lines"))
    lines = predict.fold_lines(rows, ["words", "lines"])
    wide = rows.join(F.broadcast(lines), "fold")
    error = {f: F.abs(F.col(f"slope_{f}") * F.col(f) + F.col(f"intercept_{f}") - F.col("target")) for f in ("words", "lines")}
    return wide.select("sample_id", error["words"].alias("e"), (error["words"] - error["lines"]).alias("d"))


@query("bootstrap_mae", q(f"""
SELECT (SELECT {sql_r6('avg(e)', 'm', D).rsplit(' AS ', 1)[0]} FROM s_errors) AS mae, {sql_r6('quantile_cont(e_draw, 0.025)', 'ci_low', D)}, {sql_r6('quantile_cont(e_draw, 0.975)', 'ci_high', D)} FROM s_draws"""))
def bootstrap_mae(spark, sf):
    rows = metrics.bootstrap_interval(_paired(spark, sf), "e", REPEATS)
    return rows.select(r6(F.col("point"), D).alias("mae"), r6(F.col("ci_low"), D).alias("ci_low"), r6(F.col("ci_high"), D).alias("ci_high"))


@query("paired_bootstrap", q(f"""
SELECT (SELECT {sql_r6('avg(d)', 'm', D).rsplit(' AS ', 1)[0]} FROM s_errors) AS mae_delta, {sql_r6('quantile_cont(d_draw, 0.025)', 'ci_low', D)}, {sql_r6('quantile_cont(d_draw, 0.975)', 'ci_high', D)},
  {sql_r6('avg(CASE WHEN d_draw < 0 THEN 1.0 ELSE 0.0 END)', 'probability_candidate_better', D)},
  (SELECT {sql_r6('avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END)', 'm', D).rsplit(' AS ', 1)[0]} FROM s_errors) AS candidate_win_fraction FROM s_draws"""))
def paired_bootstrap(spark, sf):
    rows = metrics.bootstrap_interval(_paired(spark, sf), "d", REPEATS)
    return rows.select(
        r6(F.col("point"), D).alias("mae_delta"), r6(F.col("ci_low"), D).alias("ci_low"), r6(F.col("ci_high"), D).alias("ci_high"),
        r6(F.col("probability_below_zero"), D).alias("probability_candidate_better"), r6(F.col("fraction_below_zero"), D).alias("candidate_win_fraction"),
    )


GROUPED = ", ".join(["count(*) AS sample_count", sql_r6(f"avg(abs({RES}))", "mae", D), sql_r6(f"quantile_cont(abs({RES}), 0.5)", "median_ae", D), sql_r6(f"avg({RES})", "bias", D)])


@query("group_comparison", q(f"""
SELECT configuration, role, sample_scope, grp, {GROUPED} FROM (
  SELECT *, 'full_sample' AS sample_scope FROM c_pred UNION ALL SELECT *, 'shared_range' FROM c_pred WHERE observed BETWEEN 92 AND 2650) GROUP BY ALL"""))
def group_comparison(spark, sf):
    rows = diagnostics.group_comparison(candidates(spark, sf), 92.0, 2650.0)
    return rounded(rows, "mae", "median_ae", "bias")


@query("residual_correlations", q(f"""
SELECT a.configuration AS configuration_1, b.configuration AS configuration_2, count(*) AS n,
  {sql_r6('corr(a.predicted - a.observed, b.predicted - b.observed)', 'pearson', 5)}
FROM c_pred a JOIN c_pred b USING (sample_id) GROUP BY 1, 2"""))
def residual_correlations(spark, sf):
    return rounded(diagnostics.residual_correlations(candidates(spark, sf), CANDIDATES), "pearson", digits=5)


fragment("s_strata", """
SELECT 'category' AS stratum_type, category AS stratum_value FROM s_split UNION ALL SELECT 'grp', grp FROM s_split UNION ALL SELECT 'resolution', resolution FROM s_split""")


@query("sample_coverage", q("SELECT stratum_type, stratum_value, count(*) AS sample_count FROM s_strata GROUP BY ALL"))
def sample_coverage(spark, sf):
    return diagnostics.coverage(samples_split(spark, sf))


@query("coverage_crosstabs", q("""
SELECT 'category' AS dim_a, 'grp' AS dim_b, category AS value_a, grp AS value_b, count(*) AS n FROM s_split GROUP BY category, grp
UNION ALL SELECT 'category', 'resolution', category, resolution, count(*) FROM s_split GROUP BY category, resolution
UNION ALL SELECT 'grp', 'resolution', grp, resolution, count(*) FROM s_split GROUP BY grp, resolution"""))
def coverage_crosstabs(spark, sf):
    return diagnostics.cross_tabs(samples_split(spark, sf))


fragment("c_strata", f"""
SELECT configuration, role, stratum_type, stratum_value, {GROUPED} FROM (
  SELECT *, 'category' AS stratum_type, category AS stratum_value FROM c_pred UNION ALL SELECT *, 'grp', grp FROM c_pred UNION ALL SELECT *, 'resolution', resolution FROM c_pred)
GROUP BY configuration, role, stratum_type, stratum_value""")


@query("stratified_metrics", q("SELECT * FROM c_strata WHERE stratum_type <> 'resolution' OR sample_count >= 10"))
def stratified_metrics(spark, sf):
    return rounded(diagnostics.stratified(candidates(spark, sf)), "mae", "median_ae", "bias")


fragment("c_cases", """
SELECT sample_id, min(observed) AS observed, min(category) AS category, min(grp) AS grp, min(resolution) AS resolution,
  max(CASE WHEN configuration = 'group_mean' THEN predicted END) AS group_mean, max(CASE WHEN configuration = 'line_words' THEN predicted END) AS line_words,
  max(CASE WHEN configuration = 'line_lines' THEN predicted END) AS line_lines, max(CASE WHEN configuration = 'line_digits' THEN predicted END) AS line_digits,
  max(predicted) - min(predicted) AS spread
FROM c_pred GROUP BY sample_id""")
fragment("c_limits", """
SELECT quantile_cont(abs(group_mean - observed), 0.9) AS q1, quantile_cont(abs(line_words - observed), 0.9) AS q2, quantile_cont(abs(line_lines - observed), 0.9) AS q3,
  quantile_cont(abs(line_digits - observed), 0.9) AS q4, quantile_cont(spread, 0.9) AS q5 FROM c_cases""")
fragment("c_hits", """
SELECT *, CAST(abs(group_mean - observed) >= q1 AS INT) + CAST(abs(line_words - observed) >= q2 AS INT) + CAST(abs(line_lines - observed) >= q3 AS INT) + CAST(abs(line_digits - observed) >= q4 AS INT) AS hits FROM c_cases, c_limits""")
CASE_COLS = "observed, category, grp, resolution, " + ", ".join(sql_r6(c, c, D) for c in CANDIDATES)


@query("notable_cases", q(f"""
SELECT sample_id, 'shared_hard_case' AS case_type, {sql_r6('hits', 'metric_value', D)}, {CASE_COLS} FROM c_hits WHERE hits >= 3
UNION ALL SELECT sample_id, 'divergent_case', {sql_r6('spread', 'metric_value', D)}, {CASE_COLS} FROM c_hits WHERE spread >= q5"""))
def notable_cases(spark, sf):
    rows = diagnostics.notable_cases(candidates(spark, sf), CANDIDATES)
    return rounded(rows, "metric_value", *CANDIDATES)


@query("shared_hard_cases", q("SELECT sample_id, CAST(hits AS BIGINT) AS hits FROM c_hits WHERE hits >= 3"))
def shared_hard_cases(spark, sf):
    rows = diagnostics.notable_cases(candidates(spark, sf), CANDIDATES)
    return rows.where("case_type = 'shared_hard_case'").select("sample_id", F.col("metric_value").cast("long").alias("hits"))


@query("divergent_cases", q("SELECT sample_id, " + sql_r6("spread", "spread", D) + " FROM c_hits WHERE spread >= q5"))
def divergent_cases(spark, sf):
    rows = diagnostics.notable_cases(candidates(spark, sf), CANDIDATES)
    return rows.where("case_type = 'divergent_case'").select("sample_id", r6(F.col("metric_value"), D).alias("spread"))


fragment("s_counts", "SELECT outer_fold, category, count(*) AS n_category, sum(count(*)) OVER (PARTITION BY outer_fold) AS n_all FROM s_train GROUP BY outer_fold, category")
fragment("s_nest_counts", """
SELECT *, CAST(round_even(n_all * CAST(0.75 AS DOUBLE), 0) AS BIGINT) AS n75, CAST(round_even(n_all * CAST(0.5 AS DOUBLE), 0) AS BIGINT) AS n50 FROM s_counts""")
from maskwright.plans.sampling import _quota  # noqa: E402

_quota("s_q75", "s_nest_counts", "n_category", "n75")
fragment("s_q75r", "SELECT outer_fold, category, n50, quota AS q75 FROM s_q75")
_quota("s_q50", "s_q75r", "q75", "n50")
fragment("s_ranked45", """
SELECT *, row_number() OVER (PARTITION BY outer_fold, category ORDER BY sha256('45:' || outer_fold || ':' || sample_id), sample_id) - 1 AS p FROM s_train""")
fragment("s_subsets", """
SELECT r.*, unnest(CASE WHEN p < quota THEN [0.5, 0.75, 1.0]::DOUBLE[] WHEN p < q75 THEN [0.75, 1.0]::DOUBLE[] ELSE [1.0]::DOUBLE[] END) AS fraction
FROM s_ranked45 r JOIN s_q50 USING (outer_fold, category)""")
fragment("s_fits", "SELECT outer_fold AS fold, fraction, count(*) AS n_train, regr_slope(target, words) AS slope, regr_intercept(target, words) AS intercept FROM s_subsets GROUP BY ALL")
fragment("s_points", """
SELECT fold, fraction, n_train, count(*) AS n_eval, avg(abs(slope * words + intercept - target)) AS mae, avg(slope * words + intercept - target) AS bias
FROM s_split JOIN s_fits USING (fold) GROUP BY fold, fraction, n_train""")


def _subsets(spark, sf):
    rows = samples_split(spark, sf, ("words",))
    n = tables.samples(spark, sf).count()
    return split.nested_subsets(rows, n=n), rows


def _points(spark, sf):
    """Points below the full size are fitted; the full-size ones come from a stored prediction table."""
    subsets, rows = _subsets(spark, sf)
    fitted = diagnostics.learning_points(subsets.where("fraction < 1.0"), rows, "words").withColumn("action", F.lit("trained"))
    return fitted.unionByName(_reused(rows)).withColumn("configuration", F.lit("line_words"))


def _reused(rows):
    stored, _ = materialize(predict.oof_predictions(rows, ["words"]))
    sizes = predict.fold_lines(rows, []).select("fold", F.col("n_train").cast("long").alias("n_train"))
    return diagnostics.reused_points(stored, "line_words", sizes)


@query("learning_points", q("SELECT CAST(fold AS BIGINT) AS fold, fraction, n_train, n_eval, " + sql_r6("mae", "mae", D) + ", " + sql_r6("bias", "bias", D) + " FROM s_points"))
def learning_points(spark, sf):
    rows = longs(_points(spark, sf).select("fold", "fraction", "n_train", "n_eval", "mae", "bias"), "fold")
    return rounded(rows, "mae", "bias")


@query("reused_points", q("SELECT CAST(fold AS BIGINT) AS fold, n_eval, n_train, " + sql_r6("mae", "mae", D) + ", " + sql_r6("bias", "bias", D) + ", CAST(1.0 AS DOUBLE) AS fraction, 'reused' AS action FROM s_points WHERE fraction = 1.0"))
def reused_points(spark, sf):
    points = _reused(samples_split(spark, sf, ("words",)))
    return rounded(longs(points, "fold"), "mae", "bias").select("fold", "n_eval", "n_train", "mae", "bias", "fraction", "action")


SUMMARY = ", ".join([sql_r6("avg(n_train)", "mean_n_train", D), sql_r6("avg(mae)", "mean_mae", D), sql_r6("stddev_pop(mae)", "std_mae", D), sql_r6("avg(bias)", "mean_bias", D)])


@query("learning_summary", q(f"SELECT 'line_words' AS configuration, fraction, {SUMMARY}, count(*) FILTER (fraction = 1.0) AS reused_points FROM s_points GROUP BY fraction"))
def learning_summary(spark, sf):
    rows = diagnostics.learning_summary(_points(spark, sf))
    return rounded(rows, "mean_n_train", "mean_mae", "std_mae", "mean_bias")


@query("learning_curve_grid", q(f"""
SELECT 'line_words' AS configuration, f.fraction, mean_mae FROM (SELECT unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS fraction) f
LEFT JOIN (SELECT fraction, {sql_r6('avg(mae)', 'mean_mae', D)} FROM s_points GROUP BY fraction) USING (fraction)"""))
def learning_curve_grid(spark, sf):
    summary = diagnostics.learning_summary(_points(spark, sf))
    return rounded(diagnostics.curve_grid(summary, [0.25, 0.5, 0.75, 1.0]), "mean_mae")


fragment("s_lrows", """
SELECT h.fold AS outer_fold, h.fraction, h.n_train, t.train_mae, validation_mae, heavy_mae FROM (
  SELECT fold, fraction, n_train, avg(abs(slope * words + intercept - target)) AS validation_mae,
    avg(CASE WHEN target >= (SELECT quantile_cont(target, 0.8) FROM s_split) THEN abs(slope * words + intercept - target) END) AS heavy_mae
  FROM s_split JOIN s_fits USING (fold) GROUP BY fold, fraction, n_train) h
JOIN (SELECT s.outer_fold AS fold, s.fraction, avg(abs(slope * words + intercept - target)) AS train_mae FROM s_subsets s JOIN s_fits f ON f.fold = s.outer_fold AND f.fraction = s.fraction GROUP BY ALL) t
  USING (fold, fraction)""")
LROW = ["train_mae", "validation_mae", "heavy_mae"]


@query("learning_rows", q("SELECT CAST(outer_fold AS BIGINT) AS outer_fold, fraction, n_train, " + ", ".join(sql_r6(c, c, D) for c in LROW) + " FROM s_lrows"))
def learning_rows(spark, sf):
    rows = diagnostics.learning_rows(*_subsets(spark, sf), "words")
    return rounded(longs(rows, "outer_fold"), *LROW)


SEEDS = (0, 1, 2, 3, 4)
fragment("rc_split", f"""
SELECT *, (row_number() OVER (PARTITION BY seed ORDER BY cno, sha256(seed || ':' || sample_id), sample_id) - 1) % 5 + 1 AS fold FROM s_cat, (SELECT unnest({list(SEEDS)}) AS seed)""")
fragment("rc_place", """
SELECT *, row_number() OVER (PARTITION BY seed, fold, cno ORDER BY sha256(seed * 101 || ':' || sample_id), sample_id) - 1 AS p, count(*) OVER (PARTITION BY seed, fold, cno) AS size FROM rc_split""")
fragment("rc_member", "SELECT r.*, fraction FROM rc_place r, (SELECT unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS fraction) WHERE p < floor(size * fraction + 0.5)")
fragment("rc_fit", "SELECT seed, fraction, outer_fold, count(*) AS n_train, regr_slope(target, words) AS a, regr_intercept(target, words) AS b FROM rc_member JOIN folds5 ON fold <> outer_fold GROUP BY ALL")
fragment("rc_train", "SELECT f.seed, f.fraction, f.outer_fold, avg(abs(a * words + b - target)) AS train_mae FROM rc_fit f JOIN rc_member m ON m.seed = f.seed AND m.fraction = f.fraction AND m.fold <> f.outer_fold GROUP BY ALL")
fragment("rc_rows", """
SELECT f.seed, f.fraction, f.outer_fold, n_train, any_value(train_mae) AS train_mae, avg(abs(a * words + b - target)) AS validation_mae,
  avg(abs(a * words + b - target)) FILTER (target >= (SELECT quantile_cont(target, 0.8) FROM s_base)) AS heavy_mae
FROM rc_fit f JOIN rc_train USING (seed, fraction, outer_fold) JOIN rc_place r ON r.seed = f.seed AND r.fold = f.outer_fold GROUP BY f.seed, f.fraction, f.outer_fold, n_train""")


def _repeated_rows(spark, sf):
    rows, n = materialize(tables.samples(spark, sf, ("words",)).withColumn("_row", F.lit(True)), "_row")
    return diagnostics.repeated_learning_rows(split.repeated_splits(rows, SEEDS), "words", n)


@query("repeated_learning_rows", q("SELECT CAST(seed AS BIGINT) AS split_seed, CAST(outer_fold AS BIGINT) AS outer_fold, fraction, n_train, " + ", ".join(sql_r6(c, c, D) for c in LROW) + " FROM rc_rows"))
def repeated_learning_rows(spark, sf):
    return rounded(longs(_repeated_rows(spark, sf), "split_seed", "outer_fold"), *LROW)


@query("repeated_curve", q("SELECT fraction, " + ", ".join(sql_r6(f"avg({c})", f"mean_{c}", D) + ", " + sql_r6(f"stddev_pop({c})", f"sd_{c}", D) for c in ["n_train", *LROW]) + " FROM rc_rows GROUP BY fraction"))
def repeated_curve(spark, sf):
    """Means and deviations over five seeds and their folds."""
    rows = diagnostics.repeated_curve(_repeated_rows(spark, sf))
    return rounded(rows, *[c for c in rows.columns if c != "fraction"])


@query("lowest_mae_candidate", q(f"SELECT configuration, {sql_r6('mae', 'mae', D)} FROM (SELECT configuration, avg(abs({RES})) AS mae FROM c_pred GROUP BY 1 ORDER BY mae, configuration LIMIT 1)"))
def lowest_mae_candidate(spark, sf):
    return rounded(metrics.lowest_mae(predictions(spark, sf)), "mae")


@query("extremes_side_by_side", q("SELECT configuration, " + ", ".join(
    sql_r6(f"avg({v}) FILTER (category = '{b}')", f"{b.lower()}_{m}", D) for b in ("B1", "B10") for m, v in (("mae", f"abs({RES})"), ("bias", RES))) + " FROM c_pred GROUP BY configuration"))
def extremes_side_by_side(spark, sf):
    rows = metrics.extremes_side_by_side(candidates(spark, sf))
    return rounded(rows, "b1_mae", "b1_bias", "b10_mae", "b10_bias")


@query("variation_table", q(f"""
SELECT configuration, n, mae, rmse, bias, r2, baseline_mae, round(mae_raw - base_raw + 1e-9, 4) + 0.0 AS delta_mae FROM (
  SELECT p.*, {sql_r6('b.mae_raw', 'baseline_mae', D)}, b.mae_raw AS base_raw FROM (SELECT configuration, {FULL}, avg(abs({RES})) AS mae_raw FROM c_pred GROUP BY configuration) p,
  (SELECT avg(abs({RES})) AS mae_raw FROM c_pred WHERE configuration = 'group_mean') b WHERE p.configuration <> 'group_mean')"""))
def variation_table(spark, sf):
    rows = diagnostics.variation_table(candidates(spark, sf), "group_mean")
    return rounded(rows, "mae", "rmse", "bias", "r2", "baseline_mae", "delta_mae")


@query("prediction_bounds", q("SELECT configuration, " + sql_r6("least(min(observed), min(predicted))", "low", D) + ", " + sql_r6("greatest(max(observed), max(predicted))", "high", D) + " FROM c_pred GROUP BY configuration"))
def prediction_bounds(spark, sf):
    return rounded(metrics.prediction_bounds(candidates(spark, sf)), "low", "high")


@query("configuration_order", q("""
SELECT name, row_number() OVER (ORDER BY first) AS place FROM (SELECT o_orderpriority AS name, min(o_orderkey) AS first FROM orders GROUP BY 1)"""))
def configuration_order(spark, sf):
    rows = tables.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("ordinal"))
    return metrics.first_appearance_order(rows, "name", "ordinal")


@query("transfer_test", q("""
SELECT train_grp, test_grp, count(*) AS n, """ + sql_r6("avg(abs(slope * words + intercept - target))", "mae", D) + """ FROM (
  SELECT b.grp AS train_grp, s.grp AS test_grp, s.words, s.target, b.slope, b.intercept FROM s_base s JOIN (
    SELECT grp, regr_slope(target, words) AS slope, regr_intercept(target, words) AS intercept FROM s_base WHERE target BETWEEN 92 AND 2650 GROUP BY grp) b ON s.grp <> b.grp
  WHERE s.target BETWEEN 92 AND 2650) GROUP BY train_grp, test_grp"""))
def transfer_test(spark, sf):
    rows = predict.transfer_predictions(tables.samples(spark, sf, ("words",)), "words", 92.0, 2650.0)
    out = rows.groupBy("train_grp", "test_grp").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("predicted") - F.col("observed"))).alias("mae"))
    return rounded(out, "mae")


@query("group_feature_correlation", q("""
SELECT grp, count(*) AS n, """ + sql_r6("corr(lines, target)", "pearson", 5) + " FROM s_base GROUP BY grp"))
def group_feature_correlation(spark, sf):
    from maskwright.functions import pearson

    rows = tables.samples(spark, sf, ("lines",)).groupBy("grp").agg(F.count("*").alias("n"), pearson(F.col("lines"), F.col("target")).alias("pearson"))
    return rounded(rows, "pearson", digits=5)
