"""Queries: redundancy of features and evidence for each of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import r6
from maskwright.operators import checks, estimators, evidence, geometry, models, predict, ranks, redundancy
from maskwright.plans import forms  # noqa: F401  (its SQL fragments are used below)
from maskwright.plans.common import LINE_FEATURES, masks_split, samples_split, text_features
from maskwright.plans.evaluation import rounded
from maskwright.plans.oracle import fragment, q, r6 as sql_r6
from maskwright.plans.registry import query
from maskwright.plans.shapes import FEATURE_SQL, grid_runs
from maskwright.session import materialize
from maskwright.sources import tables

FEATURES = list(geometry.FEATURES)
GROUPS = {"length_pair": ("words", "lines")}
BASES = list(evidence.BASELINES)
REPETITIONS = 10


def mask_feature_table(spark, sf):
    """The 26 measurements of each mask, rounded so that mathematically equal values tie."""
    measured = geometry.measure(grid_runs(spark, sf))
    # the feature index is a stored table: correlations and ranks read it several times
    stored, _ = materialize(measured.select("mask_id", *[r6(F.col(f)).alias(f) for f in FEATURES]))
    return stored


fragment("f_long", " UNION ALL ".join(f"SELECT mask_id, {i} AS k, '{f}' AS feature, {sql_r6(FEATURE_SQL[f], 'v')} FROM g_all" for i, f in enumerate(FEATURES)))
fragment("f_ranked", "SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / CAST(2 AS DOUBLE) AS rk FROM f_long")
fragment("f_corr", f"""
SELECT a.feature AS feature_a, b.feature AS feature_b, any_value(a.k) AS ka, any_value(b.k) AS kb, {sql_r6('covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0)', 'pearson', 5)},
  {sql_r6('covar_pop(a.rk, b.rk) / nullif(stddev_pop(a.rk) * stddev_pop(b.rk), 0)', 'spearman', 5)}
FROM f_ranked a JOIN f_ranked b ON a.mask_id = b.mask_id AND a.k < b.k GROUP BY a.feature, b.feature""")


def members_sql(groups) -> str:
    rows = ", ".join(f"('{name}', {i}, '{f}')" for i, (name, fs) in enumerate(groups.items()) for f in fs)
    return f"SELECT * FROM (VALUES {rows}) AS t(name, ordinal, feature)"


fragment("rel_members", members_sql(redundancy.RELATIONS))
fragment("fam_members", members_sql(redundancy.FAMILIES))
fragment("f_labels", """
SELECT c.feature_a, c.feature_b, pearson, spearman,
  coalesce((SELECT string_agg(a.name, '|' ORDER BY a.ordinal) FROM rel_members a JOIN rel_members b ON a.name = b.name WHERE a.feature = c.feature_a AND b.feature = c.feature_b), 'none') AS structural_relation,
  coalesce((SELECT arg_min(a.name, a.ordinal) FROM fam_members a JOIN fam_members b ON a.name = b.name WHERE a.feature = c.feature_a AND b.feature = c.feature_b), 'none') AS removal_group
FROM f_corr c""")


def redundancy_table(spark, sf):
    return rounded(redundancy.redundancy(mask_feature_table(spark, sf), "mask_id", FEATURES), "pearson", "spearman", digits=5)


@query("feature_redundancy", q("SELECT * FROM f_labels"))
def feature_redundancy(spark, sf):
    return redundancy_table(spark, sf)


@query("feature_relations", q("SELECT feature_a, feature_b, structural_relation, removal_group, spearman > 0 AS rises FROM f_labels WHERE structural_relation <> 'none' OR removal_group <> 'none'"))
def feature_relations(spark, sf):
    rows = redundancy_table(spark, sf).where("structural_relation != 'none' OR removal_group != 'none'")
    return rows.select("feature_a", "feature_b", "structural_relation", "removal_group", (F.col("spearman") > 0).alias("rises"))


SMALL = ["words", "lines", "digits", "commas", "capitals", "distinct_words"]
fragment("t_long", " UNION ALL ".join(f"SELECT sample_id, {i} AS k, '{f}' AS feature, {f} AS v FROM s_base" for i, f in enumerate(SMALL)))
fragment("t_ranked", "SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / CAST(2 AS DOUBLE) AS rk FROM t_long")
fragment("t_corr", f"""
SELECT a.feature AS feature_a, b.feature AS feature_b, {sql_r6('corr(a.v, b.v)', 'pearson', 5)}, {sql_r6('corr(a.rk, b.rk)', 'spearman', 5)}
FROM t_ranked a JOIN t_ranked b ON a.sample_id = b.sample_id AND a.k < b.k GROUP BY a.feature, b.feature""")


def text_correlations(spark, sf):
    rows = redundancy.correlations(text_features(spark, sf, tuple(SMALL)), "sample_id", SMALL)
    return rounded(rows, "pearson", "spearman", digits=5)


@query("text_feature_correlations", q("SELECT * FROM t_corr"))
def text_feature_correlations(spark, sf):
    return text_correlations(spark, sf)


@query("strongest_pairs", q("SELECT *, greatest(abs(pearson), abs(spearman)) AS strength FROM t_corr ORDER BY strength DESC, feature_a, feature_b LIMIT 5"))
def strongest_pairs(spark, sf):
    return redundancy.strongest(text_correlations(spark, sf), 5)


@query("correlation_matrix", q("""
SELECT feature, """ + ", ".join(f"max(CASE WHEN other = '{f}' THEN v END) AS {f}" for f in SMALL) + """ FROM (
  SELECT feature_a AS feature, feature_b AS other, pearson AS v FROM t_corr UNION ALL SELECT feature_b, feature_a, pearson FROM t_corr
  UNION ALL SELECT DISTINCT feature, feature, CAST(1 AS DOUBLE) FROM t_long) GROUP BY feature"""))
def correlation_matrix(spark, sf):
    return redundancy.matrix(text_correlations(spark, sf), SMALL)


@query("average_ranks", q("SELECT sample_id AS id, feature AS series, v AS value, rk AS rank FROM t_ranked WHERE feature IN ('lines', 'digits')"))
def average_ranks(spark, sf):
    rows = tables.samples(spark, sf, ("lines", "digits"))
    n = rows.count()
    return ranks.average_ranks(ranks.melt(rows, "sample_id", ["lines", "digits"]), n).select("id", "series", "value", "rank")


@query("removal_groups", q(members_sql(redundancy.REMOVAL_GROUPS).replace("SELECT *", "SELECT name, CAST(ordinal AS BIGINT) AS ordinal, feature, (SELECT count(*) FROM embeddings) AS n_masks")))
def removal_groups(spark, sf):
    count = tables.table(spark, sf, "embeddings").agg(F.count("*").alias("n_masks")).withColumn("_k", F.lit(0))
    rows = redundancy.membership(spark, redundancy.REMOVAL_GROUPS).withColumn("_k", F.lit(0))
    return F.broadcast(rows).join(count, "_k").select("name", F.col("ordinal").cast("long").alias("ordinal"), "feature", "n_masks")


# --- evidence -------------------------------------------------------------------------------
_c = {"w": "words", "l": "lines", "d": "digits"}
fragment("e_cov", "SELECT outer_fold AS fold, avg(target) AS my, " + ", ".join(f"avg({v}) AS m{k}" for k, v in _c.items()) + ", " + ", ".join(
    f"covar_pop({_c[a]}, {_c[b]}) AS c{a}{b}" for a, b in ("ww", "wl", "wd", "ll", "ld", "dd")) + ", " + ", ".join(f"covar_pop({v}, target) AS y{k}" for k, v in _c.items()) + " FROM s_train GROUP BY outer_fold")
fragment("e_base", """
SELECT c.fold, my, mw, ml, md, cww * (1 + s) AS cww, cwl, cwd, cll * (1 + s) AS cll, cld, cdd * (1 + s) AS cdd, yw, yl, yd, b.baseline
FROM e_cov c, (SELECT unnest(['ordinary', 'ridge']) AS baseline, unnest([0.0, 0.1]::DOUBLE[]) AS s) b""")
fragment("e_models", """
SELECT fold, baseline, experiment, target_name, bw, bl, bd, my - bw * mw - bl * ml - bd * md AS b0 FROM (
  SELECT *, 'full' AS experiment, '' AS target_name,
    (yw * (cll * cdd - cld * cld) - cwl * (yl * cdd - cld * yd) + cwd * (yl * cld - cll * yd)) / det AS bw,
    (cww * (yl * cdd - cld * yd) - yw * (cwl * cdd - cld * cwd) + cwd * (cwl * yd - yl * cwd)) / det AS bl,
    (cww * (cll * yd - yl * cld) - cwl * (cwl * yd - yl * cwd) + yw * (cwl * cld - cll * cwd)) / det AS bd
  FROM (SELECT *, cww * (cll * cdd - cld * cld) - cwl * (cwl * cdd - cld * cwd) + cwd * (cwl * cld - cll * cwd) AS det FROM e_base)
  UNION ALL BY NAME SELECT *, 'isolated' AS experiment, 'words' AS target_name, yw / cww AS bw, 0.0 AS bl, 0.0 AS bd FROM e_base
  UNION ALL BY NAME SELECT *, 'isolated' AS experiment, 'lines' AS target_name, 0.0 AS bw, yl / cll AS bl, 0.0 AS bd FROM e_base
  UNION ALL BY NAME SELECT *, 'isolated' AS experiment, 'digits' AS target_name, 0.0 AS bw, 0.0 AS bl, yd / cdd AS bd FROM e_base
  UNION ALL BY NAME SELECT *, 'removal' AS experiment, 'words' AS target_name, 0.0 AS bw, (yl * cdd - cld * yd) / (cll * cdd - cld * cld) AS bl, (cll * yd - cld * yl) / (cll * cdd - cld * cld) AS bd FROM e_base
  UNION ALL BY NAME SELECT *, 'removal' AS experiment, 'lines' AS target_name, (yw * cdd - cwd * yd) / (cww * cdd - cwd * cwd) AS bw, 0.0 AS bl, (cww * yd - cwd * yw) / (cww * cdd - cwd * cwd) AS bd FROM e_base
  UNION ALL BY NAME SELECT *, 'removal' AS experiment, 'digits' AS target_name, (yw * cll - cwl * yl) / (cww * cll - cwl * cwl) AS bw, (cww * yl - cwl * yw) / (cww * cll - cwl * cwl) AS bl, 0.0 AS bd FROM e_base
  UNION ALL BY NAME SELECT *, 'removal' AS experiment, 'length_pair' AS target_name, 0.0 AS bw, 0.0 AS bl, yd / cdd AS bd FROM e_base)""")
fragment("e_full", """
SELECT s.sample_id, s.fold, s.target, s.words, s.lines, s.digits, baseline, bw, bl, bd, abs(bw * words + bl * lines + bd * digits + b0 - s.target) AS err, bw * words + bl * lines + bd * digits + b0 AS pred
FROM s_split s JOIN e_models m ON m.fold = s.fold AND m.experiment = 'full'""")
fragment("e_place", "SELECT sample_id, fold, row_number() OVER (PARTITION BY fold ORDER BY sha256('0:' || sample_id), sample_id) AS place FROM s_split")
fragment("e_donor", f"""
SELECT fold, feature, rep, v, row_number() OVER (PARTITION BY fold, feature, rep ORDER BY sha256(seed || ':' || sample_id), sample_id) AS place FROM (
  SELECT s.sample_id, s.fold, u.feature, u.v, rep, CAST('0x' || substr(sha256('42:' || s.fold || ':' || u.feature || ':' || rep), 1, 8) AS BIGINT) AS seed
  FROM s_split s, LATERAL (SELECT unnest([{{'feature': 'words', 'v': words}}, {{'feature': 'lines', 'v': lines}}, {{'feature': 'digits', 'v': digits}}]) AS u), (SELECT unnest(range(0, {REPETITIONS})) AS rep))""")
fragment("e_errors", """
SELECT m.experiment, m.baseline, m.target_name AS target, s.fold, CAST(NULL AS BIGINT) AS repetition, abs(m.bw * s.words + m.bl * s.lines + m.bd * s.digits + b0 - s.target) AS e, CASE WHEN experiment = 'removal' THEN f.err END AS r
FROM s_split s JOIN e_models m ON m.fold = s.fold AND m.experiment <> 'full' JOIN e_full f ON f.sample_id = s.sample_id AND f.baseline = m.baseline
UNION ALL SELECT 'permutation', f.baseline, d.feature, f.fold, d.rep,
  abs(f.pred + CASE d.feature WHEN 'words' THEN bw * (d.v - words) WHEN 'lines' THEN bl * (d.v - lines) ELSE bd * (d.v - digits) END - f.target), f.err
FROM e_full f JOIN e_place p USING (sample_id) JOIN e_donor d ON d.fold = f.fold AND d.place = p.place""")
fragment("e_rows", """
SELECT experiment, baseline, target, scope, fold, repetition, n, ref AS reference, res AS result, res - ref AS delta,
  CASE WHEN res - ref < -1 THEN 'improvement' WHEN res - ref > 1 THEN 'harm' WHEN ref IS NOT NULL THEN 'neutral' END AS effect,
  CASE WHEN experiment = 'permutation' AND scope = 'fold' THEN CAST('0x' || substr(sha256('42:' || fold || ':' || target || ':' || repetition), 1, 8) AS BIGINT) END AS seed
FROM (SELECT experiment, baseline, target, 'fold' AS scope, fold, repetition, count(*) AS n, avg(r) AS ref, avg(e) AS res FROM e_errors GROUP BY ALL
  UNION ALL SELECT experiment, baseline, target, 'oof', NULL, repetition, count(*), avg(r), avg(e) FROM e_errors GROUP BY experiment, baseline, target, repetition)""")


def evidence_table(spark, sf, permutations: bool = True):
    rows = samples_split(spark, sf, tuple(LINE_FEATURES))
    return evidence.evidence(rows, LINE_FEATURES, GROUPS, REPETITIONS, n=tables.samples(spark, sf).count(), permutations=permutations)


def as_text(df):
    """Nullable integers as text, so that both engines show them alike."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in ("fold", "repetition", "seed") else F.col(c) for c in df.columns])


EV = ", ".join(["experiment, baseline, target, scope, CAST(fold AS VARCHAR) AS fold, CAST(repetition AS VARCHAR) AS repetition, CAST(seed AS VARCHAR) AS seed, n"] + [sql_r6(c, c, 4) for c in ("reference", "result", "delta")] + ["effect"])


@query("feature_evidence", q(f"SELECT {EV} FROM e_rows"))
def feature_evidence(spark, sf):
    return as_text(rounded(evidence.canonical_order(evidence_table(spark, sf)), "reference", "result", "delta"))


@query("estimator_evidence", q(f"SELECT {EV} FROM e_rows WHERE baseline = 'ordinary'"))
def estimator_evidence(spark, sf):
    """The same table through a plugged-in Spark ML estimator, whose fitted models must give the closed form's numbers."""
    rows, n = materialize(samples_split(spark, sf, tuple(LINE_FEATURES)).withColumn("_row", F.lit(True)), "_row")
    out = estimators.estimator_evidence(rows, LINE_FEATURES, GROUPS, {"ordinary": estimators.linear_runner()}, REPETITIONS, n=n)
    return as_text(rounded(evidence.canonical_order(out), "reference", "result", "delta"))


@query("forest_evidence", q("""
SELECT experiment, target, scope, CAST(fold AS VARCHAR) AS fold, CAST(repetition AS VARCHAR) AS repetition, CAST(seed AS VARCHAR) AS seed, n, TRUE AS own_reference, TRUE AS sound,
  CASE WHEN experiment = 'isolated' THEN 'alone' WHEN target = 'words' AND experiment = 'permutation' THEN 'harm' ELSE 'any' END AS effect
FROM e_rows WHERE baseline = 'ordinary'"""))
def forest_evidence(spark, sf):
    """Evidence through the forest of the registered recipe: 10 permutations for each feature, no refit.

    `own_reference`: a fold's reference is the error of the separate out-of-fold forest; `sound`: the difference is that of result
    and reference. Shuffling the strongest feature must harm.
    """
    rows, n = materialize(samples_split(spark, sf, tuple(LINE_FEATURES)).withColumn("_row", F.lit(True)), "_row")
    out, _ = materialize(estimators.estimator_evidence(rows, LINE_FEATURES, GROUPS, {"forest": estimators.forest_runner()}, REPETITIONS, n=n))
    alone = models.oof_forest(rows, LINE_FEATURES).withColumn("e", F.abs(F.col("predicted") - F.col("observed")))
    errors = alone.groupBy("fold").agg(F.avg("e").alias("own")).unionByName(alone.agg(F.avg("e").alias("own")).withColumn("fold", F.lit(None).cast("int"))).withColumnRenamed("fold", "f")
    joined = out.join(F.broadcast(errors), F.col("fold").eqNullSafe(F.col("f")))
    effect = F.when(F.col("experiment") == "isolated", "alone").when((F.col("experiment") == "permutation") & (F.col("target") == "words"), F.col("effect")).otherwise("any")
    return as_text(joined.select(
        "experiment", "target", "scope", "fold", "repetition", "seed", "n",
        ((F.col("experiment") == "isolated") | (F.abs(F.col("reference") - F.col("own")) <= 1e-6 * F.col("own"))).alias("own_reference"),
        ((F.col("experiment") == "isolated") | (F.abs(F.col("result") - F.col("reference") - F.col("delta")) <= 1e-9)).alias("sound"), effect.alias("effect"),
    ))


@query("removal_evidence", q(f"SELECT {EV} FROM e_rows WHERE experiment = 'removal'"))
def removal_evidence(spark, sf):
    rows = evidence_table(spark, sf, False).where("experiment = 'removal'")
    return as_text(rounded(rows, "reference", "result", "delta"))


@query("removal_recommendations", q("""
SELECT target, round(delta_ordinary + 1e-9, 4) + 0.0 AS delta_ordinary, round(delta_ridge + 1e-9, 4) + 0.0 AS delta_ridge,
  CASE WHEN greatest(delta_ordinary, delta_ridge) > 1 THEN 'retain_harm_veto' WHEN least(delta_ordinary, delta_ridge) < -1 THEN 'recommend_removal' ELSE 'retain_double_neutral' END AS recommendation
FROM (SELECT target, max(delta) FILTER (baseline = 'ordinary') AS delta_ordinary, max(delta) FILTER (baseline = 'ridge') AS delta_ridge FROM e_rows WHERE experiment = 'removal' AND scope = 'oof' GROUP BY target)"""))
def removal_recommendations(spark, sf):
    return rounded(evidence.recommendations(evidence_table(spark, sf, False), BASES), "delta_ordinary", "delta_ridge")


@query("permutation_effects", q("SELECT baseline, target, " + ", ".join(sql_r6(f"{f}(delta)", f"{n}_delta", 4) for f, n in (("avg", "mean"), ("min", "min"), ("max", "max"))) + " FROM e_rows WHERE experiment = 'permutation' AND scope = 'oof' GROUP BY ALL"))
def permutation_effects(spark, sf):
    return rounded(evidence.permutation_effects(evidence_table(spark, sf)), "mean_delta", "min_delta", "max_delta")


@query("permuted_values", q("""
SELECT p.sample_id, d.feature, CAST(d.rep AS BIGINT) AS repetition, d.v AS given FROM e_place p JOIN e_donor d ON d.fold = p.fold AND d.place = p.place"""))
def permuted_values(spark, sf):
    rows = samples_split(spark, sf, tuple(LINE_FEATURES))
    n = tables.samples(spark, sf).count()
    # a small task size, so that the groups are cut into hash buckets
    out = evidence.permuted_values(rows, LINE_FEATURES, REPETITIONS, 42, n, rows_per_task=max(1, n // 40))
    return out.select("sample_id", "feature", F.col("repetition").cast("long").alias("repetition"), "given")


def _tampered(spark, sf):
    """Removal evidence with rows left out, repeated, and values changed."""
    rows = evidence_table(spark, sf, False)
    lost = rows.where("NOT (experiment = 'removal' AND target = 'words' AND fold <=> 2)")
    twice = rows.where("experiment = 'isolated' AND target = 'lines' AND fold = 1")
    return lost.unionByName(twice)


@query("evidence_key_grid", q(f"""
SELECT * FROM (
  SELECT 'removal' AS experiment, baseline, 'words' AS target, 'fold' AS scope, '2' AS fold, NULL::VARCHAR AS repetition, CAST(0 AS BIGINT) AS n_actual, 'missing' AS problem FROM (SELECT DISTINCT baseline FROM e_base)
  UNION ALL SELECT 'isolated', baseline, 'lines', 'fold', '1', NULL, 2, 'duplicate' FROM (SELECT DISTINCT baseline FROM e_base)
  UNION ALL SELECT 'permutation', baseline, feature, scope, fold, CAST(rep AS VARCHAR), 0, 'missing' FROM (SELECT DISTINCT baseline FROM e_base), (SELECT unnest(['words', 'lines', 'digits']) AS feature), (SELECT unnest(range(0, {REPETITIONS})) AS rep),
    (SELECT 'fold' AS scope, CAST(outer_fold AS VARCHAR) AS fold FROM folds5 UNION ALL SELECT 'oof', NULL))"""))
def evidence_key_grid(spark, sf):
    expected = evidence.expected_keys(samples_split(spark, sf), LINE_FEATURES, GROUPS, BASES, REPETITIONS)
    return as_text(checks.key_differences(expected, _tampered(spark, sf)))


@query("evidence_arithmetic", q("""
SELECT experiment, baseline, target, scope, CAST(fold AS VARCHAR) AS fold, CASE WHEN fold = 3 THEN 'n' WHEN fold = 4 THEN 'delta' ELSE 'effect' END AS problem
FROM e_rows WHERE experiment = 'removal' AND (fold IN (3, 4) OR (scope = 'oof' AND effect IS DISTINCT FROM 'harm'))"""))
def evidence_arithmetic(spark, sf):
    rows = evidence_table(spark, sf, False)
    removal = F.col("experiment") == "removal"
    wrong = (
        rows.withColumn("n", F.when(removal & (F.col("fold") == 3), F.col("n") + 1).otherwise(F.col("n")))
        .withColumn("delta", F.when(removal & (F.col("fold") == 4), F.col("delta") + 0.5).otherwise(F.col("delta")))
        .withColumn("effect", F.when(removal & (F.col("scope") == "oof"), F.lit("harm")).otherwise(F.col("effect")))
    )
    sizes = samples_split(spark, sf).groupBy("fold").agg(F.count("*").alias("size"))
    return as_text(checks.evidence_arithmetic(wrong, sizes).select("experiment", "baseline", "target", "scope", "fold", "problem"))


@query("evidence_seeds", q("""
SELECT target, CAST(fold AS VARCHAR) AS fold, CAST(repetition AS VARCHAR) AS repetition, CAST(seed + 1 AS VARCHAR) AS seed, CAST(seed AS VARCHAR) AS expected_seed FROM e_rows WHERE experiment = 'permutation' AND baseline = 'ridge' AND fold = 5"""))
def evidence_seeds(spark, sf):
    rows = evidence_table(spark, sf)
    off = (F.col("baseline") == "ridge") & (F.col("fold") == 5) & (F.col("experiment") == "permutation")
    wrong = rows.withColumn("seed", F.when(off, F.col("seed") + 1).otherwise(F.col("seed")))
    out = checks.evidence_seeds(wrong).select("target", "fold", "repetition", "seed", F.col("expected_seed").cast("string").alias("expected_seed"))
    return as_text(out)


@query("redundancy_rows_check", q("""
SELECT feature_b AS feature_a, feature_a AS feature_b, 'pair' AS problem FROM t_corr WHERE feature_a = 'words'
UNION ALL SELECT feature_a, feature_b, 'correlation' FROM t_corr WHERE feature_a = 'lines'"""))
def redundancy_rows_check(spark, sf):
    rows = text_correlations(spark, sf).withColumn("structural_relation", F.lit("none")).withColumn("removal_group", F.lit("none"))
    swap = F.col("feature_a") == "words"
    wrong = rows.select(
        F.when(swap, F.col("feature_b")).otherwise(F.col("feature_a")).alias("feature_a"), F.when(swap, F.col("feature_a")).otherwise(F.col("feature_b")).alias("feature_b"),
        F.when(F.col("feature_a") == "lines", F.lit(1.5)).otherwise(F.col("pearson")).alias("pearson"), "spearman", "structural_relation", "removal_group",
    )
    return checks.redundancy_rows(wrong, SMALL, list(redundancy.RELATIONS), list(redundancy.REMOVAL_GROUPS)).select("feature_a", "feature_b", "problem")


@query("evidence_order", q("""
SELECT sample_id, fold_no AS fold FROM (SELECT sample_id, CAST(fold AS BIGINT) AS fold_no, lag(fold) OVER (PARTITION BY category ORDER BY sample_id) AS p FROM o_split) WHERE fold_no < p"""))
def evidence_order(spark, sf):
    from maskwright.plans.common import orders_split

    rows = checks.out_of_order(orders_split(spark, sf), "sample_id", [F.col("fold")], "category")
    return rows.select("sample_id", F.col("fold").cast("long").alias("fold"))


fragment("q_values", """
SELECT metric, v, e FROM (
  SELECT 'foreground_ratio' AS metric, a / CAST(64 AS DOUBLE) AS v, abs(target - m) AS e FROM g_box JOIN mq_err USING (mask_id)
  UNION ALL SELECT 'component_count', n, abs(target - m) FROM (SELECT mask_id, CAST(count(*) AS DOUBLE) AS n FROM gc_sizes GROUP BY 1) JOIN mq_err USING (mask_id)
  UNION ALL SELECT 'hole_ratio', round(coalesce(holes, 0) / a, 9), abs(target - m) FROM g_box LEFT JOIN g_holes USING (mask_id) JOIN mq_err USING (mask_id))""")
fragment("mq_err", "SELECT s.mask_id, s.target, (SELECT avg(t.target) FROM m_split t WHERE t.fold <> s.fold) AS m FROM m_split s")


@query("quality_error_association", q("SELECT metric, count(*) AS n, " + sql_r6("corr(rv, re)", "spearman", 5) + """ FROM (
  SELECT metric, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / CAST(2 AS DOUBLE) AS rv,
    rank() OVER (PARTITION BY metric ORDER BY e) + (count(*) OVER (PARTITION BY metric, e) - 1) / CAST(2 AS DOUBLE) AS re FROM (SELECT metric, v, round(e, 6) AS e FROM q_values)) GROUP BY metric"""))
def quality_error_association(spark, sf):
    rows = _quality_errors(spark, sf)
    out = ranks.spearman(rows, "mask_id", [(c, "error") for c in ("foreground_ratio", "component_count", "hole_ratio")])
    return out.select(F.col("left").alias("metric"), "n", r6(F.col("rho"), 5).alias("spearman"))


def _quality_errors(spark, sf):
    from maskwright.operators import morphology
    from maskwright.plans.forms import grid_dims

    quality = morphology.quality(grid_runs(spark, sf), grid_dims(spark, sf))
    errors = predict.training_mean(masks_split(spark, sf)).select("mask_id", F.round(F.abs(F.col("predicted") - F.col("target")), 6).alias("error"))
    return quality.join(errors, "mask_id").select(
        "mask_id", "foreground_ratio", F.col("component_count").cast("double").alias("component_count"), F.round("hole_ratio", 9).alias("hole_ratio"), "error"
    )


@query("quality_error_p_values", None)
def quality_error_p_values(spark, sf):
    out = ranks.spearman(_quality_errors(spark, sf), "mask_id", [(c, "error") for c in ("foreground_ratio", "component_count", "hole_ratio")])
    return out.select(F.col("left").alias("metric"), r6(F.col("p_value"), 6).alias("p_value"))
