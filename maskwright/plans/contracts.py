"""Queries: sources and sinks, constraint checks, scalar rules and fingerprints.

The checks run on tables into which known faults were put, so that each has violations to find.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from maskwright import functions as fn
from maskwright.functions import r6
from maskwright.operators import checks, diagnostics, fingerprint, metrics, split
from maskwright.plans import forms  # noqa: F401  (its SQL fragments are used below)
from maskwright.plans.common import candidates, orders_split, predictions, samples_split
from maskwright.plans.evaluation import CANDIDATES, RES
from maskwright.plans.oracle import fragment, q, r6 as sql_r6
from maskwright.plans.registry import query
from maskwright.session import materialize, shared_dir, spread
from maskwright.sources import files, tables


def fresh_path(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/maskwright/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ----------------------------------------------------------------------
def orders_index(spark, sf):
    return tables.table(spark, sf, "orders").select(
        F.concat(F.lit("m"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("file_name"),
        F.col("o_orderpriority").alias("farm"), F.col("o_totalprice").alias("weight_kg"),
    )


@query("index_csv_round_trip", q("SELECT 'm' || o_orderkey || '.png' AS file_name, o_orderpriority AS farm, round(o_totalprice, 2) AS weight_kg FROM orders"))
def index_csv_round_trip(spark, sf):
    path = fresh_path(spark, "index")
    files.write_csv_table(orders_index(spark, sf), path, ["file_name"])
    return files.read_index(spark, path).withColumn("weight_kg", F.round("weight_kg", 2))


@query("csv_text_rows", q("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, coalesce(printf('%.6f', CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END), '') AS value FROM events"))
def csv_text_rows(spark, sf):
    rows = tables.table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return files.as_text(rows)


@query("json_rows", q("SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation"))
def json_rows(spark, sf):
    path = fresh_path(spark, "json")
    files.write_json_rows(tables.table(spark, sf, "nation").select("n_name", "n_nationkey"), path)
    return spark.read.schema("n_name string, n_nationkey long").json(path).agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys"))


@query("feature_index_build", q("""
SELECT mask_id, grp, target, area, bbox_width FROM (SELECT mask_id, """ + sql_r6("a", "area") + ", " + sql_r6("rr - l + 1", "bbox_width") + " FROM g_box) JOIN m_base USING (mask_id)"))
def feature_index_build(spark, sf):
    from maskwright.operators import geometry
    from maskwright.plans.shapes import grid_runs

    path = fresh_path(spark, "features")
    measured = geometry.measure(grid_runs(spark, sf), with_hull=False)
    index = tables.mask_targets(spark, sf).select(F.col("sample_id").alias("mask_id"), "grp", "target")
    index.join(measured, "mask_id").write.parquet(path)
    stored = spark.read.parquet(path)
    return stored.select("mask_id", "grp", "target", r6(F.col("area")).alias("area"), r6(F.col("bbox_width")).alias("bbox_width"))


@query("feature_samples", q("SELECT sample_id, words, category, CAST(fold AS BIGINT) AS fold, target FROM s_split"))
def feature_samples(spark, sf):
    rows = samples_split(spark, sf).select("sample_id", "category", F.col("fold").cast("long").alias("fold"), "target")
    return files.feature_samples(tables.samples(spark, sf, ("words",)).select("sample_id", "words"), rows, "sample_id")


@query("combined_predictions", q("SELECT configuration, approach, 'baseline' AS role, sample_id, grp, resolution, CAST(fold AS BIGINT) AS fold, " + sql_r6("predicted", "predicted", 4) + " FROM c_pred WHERE configuration <> 'group_mean'"))
def combined_predictions(spark, sf):
    long = predictions(spark, sf)
    layouts = {
        "mean_reference": ("mean", "reference", {"sample_id": "file_name", "fold": "fold", "predicted": "predicted_weight_kg"}),
        "line_words": ("least_squares", "candidate", {"sample_id": "file_name", "fold": "fold", "predicted": "predicted_kg"}),
        "line_lines": ("least_squares", "candidate", {"sample_id": "name", "fold": "outer_fold", "predicted": "prediction_kg"}),
        "line_digits": ("least_squares", "candidate", {"sample_id": "id", "fold": "part", "predicted": "estimate"}),
    }
    out = None
    for name, (approach, role, names) in layouts.items():
        source = long.where(F.col("configuration") == name).select(*[F.col(c).alias(s) for c, s in names.items()])
        part = files.normalise_predictions(source, names, name, approach, role)
        out = part if out is None else out.unionByName(part)
    dimensions = tables.samples(spark, sf).select("sample_id", "grp", "resolution")
    rows = files.decorate(out, dimensions, "sample_id")
    return rows.select("configuration", "approach", "role", "sample_id", "grp", "resolution", F.col("fold").cast("long").alias("fold"), r6(F.col("predicted"), 4).alias("predicted"))


STEM_SQL = "SELECT doc_id % (SELECT count(*) * 7 // 10 FROM documents) || CASE doc_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.txt' END AS name FROM documents"
fragment("file_names", STEM_SQL)
fragment("file_parts", "SELECT DISTINCT name, split_part(name, '.', 1) AS stem, '.' || split_part(name, '.', 2) AS suffix FROM file_names")


def file_names(spark, sf):
    docs = tables.table(spark, sf, "documents")
    modulus = docs.count() * 7 // 10
    suffix = F.when(F.col("doc_id") % 3 == 0, ".jpg").when(F.col("doc_id") % 3 == 1, ".png").otherwise(".txt")
    return docs.select(F.concat((F.col("doc_id") % modulus).cast("string"), suffix).alias("name")).distinct()


@query("preferred_files", q("SELECT stem, arg_min(name, CASE suffix WHEN '.png' THEN 0 ELSE 1 END) AS name, count(*) AS n_files FROM file_parts WHERE suffix IN ('.png', '.jpg') GROUP BY stem"))
def preferred_files(spark, sf):
    return files.resolve_stems(file_names(spark, sf))


@query("files_per_stem", q("SELECT stem, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM file_parts GROUP BY stem HAVING count(*) > 1"))
def files_per_stem(spark, sf):
    return checks.several_files_per_stem(file_names(spark, sf))


# --- constraint checks ----------------------------------------------------------------------
@query("row_count_check", q("SELECT CAST(132 AS BIGINT) AS expected, count(*) AS actual FROM orders HAVING count(*) <> 132"))
def row_count_check(spark, sf):
    return checks.row_count(tables.table(spark, sf, "orders"), 132)


@query("value_domain_check", q("""
SELECT * FROM (SELECT 'm' || o_orderkey || CASE WHEN o_orderkey % 11 = 0 THEN '.bmp' ELSE '.png' END AS file_name, CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE o_orderpriority END AS grp,
  CASE WHEN o_orderkey % 17 = 0 THEN -o_totalprice ELSE o_totalprice END AS target, unnest(list_filter([CASE WHEN o_orderkey % 11 = 0 THEN 'file_name' END, CASE WHEN o_orderkey % 13 = 0 THEN 'grp' END, CASE WHEN o_orderkey % 17 = 0 THEN 'target' END], lambda x: x IS NOT NULL)) AS rule FROM orders)"""))
def value_domain_check(spark, sf):
    key = F.col("o_orderkey")
    index = tables.table(spark, sf, "orders").select(
        F.concat(F.lit("m"), key.cast("string"), F.when(key % 11 == 0, ".bmp").otherwise(".png")).alias("file_name"),
        F.when(key % 13 == 0, " ").otherwise(F.col("o_orderpriority")).alias("grp"),
        F.when(key % 17 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("target"),
    )
    return checks.value_domains(index)


@query("duplicate_key_check", q("SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"))
def duplicate_key_check(spark, sf):
    return checks.duplicate_keys(tables.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("missing_and_extra_check", q("SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 2 = 0 UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id % 2 = 1"))
def missing_and_extra_check(spark, sf):
    return checks.missing_and_extra(tables.table(spark, sf, "documents").where("doc_id % 2 = 0"), tables.table(spark, sf, "labels"), "doc_id")


@query("pixel_value_check", q("SELECT vec_id AS mask_id, CAST(vec_id % 255 AS VARCHAR) AS preview FROM embeddings WHERE vec_id % 5 = 0 AND vec_id % 255 <> 0 AND list_bool_or(list_transform(embedding, lambda v: v <= 0))"))
def pixel_value_check(spark, sf):
    odd = F.when((F.col("mask_id") % 5 == 0), (F.col("mask_id") % 255).cast("int")).otherwise(F.lit(0))
    gray = tables.grid_bits(spark, sf).select("mask_id", F.transform("bits", lambda b: F.when(b, 255).otherwise(odd)).alias("values"))
    return checks.pixel_values(gray).select("mask_id", F.array_join(F.col("preview").cast("array<string>"), ",").alias("preview"))


def with_row_count(problems, df):
    """Schema problems next to the number of rows they concern."""
    count = df.agg(F.count("*").alias("n_rows")).withColumn("_k", F.lit(0))
    return problems.withColumn("_k", F.lit(0)).join(F.broadcast(count), "_k").drop("_k")


@query("exact_column_check", q("""
SELECT *, (SELECT count(*) FROM documents) AS n_rows FROM (VALUES (CAST(2 AS BIGINT), 'language', 'lang'), (5, 'license', NULL)) AS t(position, expected, actual)"""))
def exact_column_check(spark, sf):
    docs = tables.table(spark, sf, "documents")
    found = checks.exact_columns(docs, ["doc_id", "text", "language", "source", "n_chars", "license"])
    return with_row_count(found.withColumn("position", F.col("position").cast("long")), docs)


@query("required_column_check", q("SELECT 'license' AS missing, count(*) AS n_rows FROM documents"))
def required_column_check(spark, sf):
    docs = tables.table(spark, sf, "documents")
    return with_row_count(checks.required_columns(docs, ["doc_id", "text", "license"]), docs)


def faulty_predictions(spark, sf):
    """Some predictions left out, some repeated."""
    rows = candidates(spark, sf)
    lost = rows.where("NOT (configuration = 'line_words' AND sample_id % 10 = 3)")
    return lost.unionByName(rows.where("configuration = 'group_mean' AND sample_id % 20 = 7"))


@query("prediction_coverage_check", q("""
SELECT 'line_words' AS configuration, sample_id, CAST(0 AS BIGINT) AS n, TRUE AS known FROM s_base WHERE sample_id % 10 = 3 UNION ALL SELECT 'group_mean', sample_id, 2, TRUE FROM s_base WHERE sample_id % 20 = 7"""))
def prediction_coverage_check(spark, sf):
    return checks.prediction_coverage(faulty_predictions(spark, sf), tables.samples(spark, sf))


@query("prediction_identity_check", q("""
SELECT configuration, sample_id, 'B0' AS category, CAST(fold AS BIGINT) AS fold, observed, category AS expected_category, CAST(fold AS BIGINT) AS expected_fold, observed AS expected_observed FROM c_pred WHERE sample_id % 50 = 1"""))
def prediction_identity_check(spark, sf):
    rows = candidates(spark, sf).withColumn("category", F.when(F.col("sample_id") % 50 == 1, "B0").otherwise(F.col("category")))
    out = checks.identity_differences(rows, samples_split(spark, sf))
    return out.withColumn("fold", F.col("fold").cast("long")).withColumn("expected_fold", F.col("expected_fold").cast("long"))


@query("finite_value_check", q("SELECT sample_id, configuration FROM c_pred WHERE sample_id % 30 IN (1, 2, 3)"))
def finite_value_check(spark, sf):
    rest = F.col("sample_id") % 30
    bad = F.when(rest == 1, float("nan")).when(rest == 2, float("inf")).when(rest == 3, F.lit(None)).otherwise(F.col("predicted"))
    return checks.non_finite(candidates(spark, sf).withColumn("predicted", bad), "observed", "predicted").select("sample_id", "configuration")


@query("six_decimal_check", q("SELECT l_orderkey, l_partkey, printf('%.2f', l_extendedprice) AS text FROM lineitem WHERE l_orderkey % 9 = 0"))
def six_decimal_check(spark, sf):
    price = F.col("l_extendedprice")
    text = F.when(F.col("l_orderkey") % 9 == 0, F.format_string("%.2f", price)).otherwise(F.format_string("%.6f", price))
    return checks.six_decimals(tables.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", text.alias("text")), "text")


@query("metric_row_check", q("SELECT configuration, CAST(fold AS BIGINT) AS fold, 'value' AS problem FROM c_pred WHERE fold = 2 GROUP BY configuration, fold UNION ALL SELECT configuration, CAST(fold AS BIGINT), 'missing' FROM c_pred WHERE fold = 5 GROUP BY configuration, fold"))
def metric_row_check(spark, sf):
    computed = candidates(spark, sf).groupBy("configuration", F.col("fold").cast("long").alias("fold")).agg(*metrics.metric_columns())
    stored = computed.where("fold != 5").withColumn("mae", F.when(F.col("fold") == 2, F.col("mae") + 1).otherwise(F.col("mae")))
    return checks.metric_differences(stored, computed, ["configuration", "fold"], ["mae", "rmse", "bias", "r2"])


@query("residual_check", q("SELECT configuration, sample_id FROM c_pred WHERE sample_id % 40 = 5"))
def residual_check(spark, sf):
    r = fn.residual(F.col("observed"), F.col("predicted"))
    rows = candidates(spark, sf).withColumn("residual", r + F.when(F.col("sample_id") % 40 == 5, 0.25).otherwise(0.0)).withColumn("absolute_error", F.abs(r))
    return checks.residual_arithmetic(rows).select("configuration", "sample_id")


def fold_membership(spark, sf):
    """(outer_fold, role, sample_id) for held out, selection, stopping and refit."""
    rows = orders_split(spark, sf)
    inner = split.inner_holdout(rows, n=tables.samples_large(spark, sf).count())
    parts = inner.select("outer_fold", "sample_id", F.explode(F.array(F.col("inner_role"), F.lit("refit"))).alias("role"))
    return parts.unionByName(rows.select(F.col("fold").alias("outer_fold"), "sample_id", F.lit("held_out").alias("role")))


@query("fold_isolation_check", q("SELECT CAST(fold AS BIGINT) AS outer_fold, sample_id, 'selection' AS role FROM o_split WHERE sample_id % 100 = 3"))
def fold_isolation_check(spark, sf):
    membership = fold_membership(spark, sf)
    leaked = membership.where("role = 'held_out' AND sample_id % 100 = 3").withColumn("role", F.lit("selection"))
    out = checks.fold_isolation(membership.unionByName(leaked))
    return out.select(F.col("outer_fold").cast("long").alias("outer_fold"), "sample_id", "role")


@query("fold_partition_check", q("""
SELECT t.outer_fold, t.n - s.n_stop - 1 AS selection, s.n_stop AS stopping, t.n AS refit, h.n AS held_out FROM (SELECT outer_fold, count(*) AS n FROM o_train GROUP BY 1) t
JOIN (SELECT outer_fold, any_value(n_stop) AS n_stop FROM o_stop_counts GROUP BY 1) s USING (outer_fold) JOIN (SELECT fold AS outer_fold, count(*) AS n FROM o_split GROUP BY 1) h USING (outer_fold) WHERE outer_fold = 2"""))
def fold_partition_check(spark, sf):
    membership = fold_membership(spark, sf)
    first = membership.where("outer_fold = 2 AND role = 'selection'").agg(F.min("sample_id").alias("sample_id"))
    lost = first.select("sample_id", F.lit(2).alias("outer_fold"), F.lit("selection").alias("role"))
    rest = membership.join(F.broadcast(lost), ["outer_fold", "sample_id", "role"], "left_anti")
    out = checks.partition_arithmetic(rest, tables.samples_large(spark, sf).count())
    return out.select(F.col("outer_fold").cast("long").alias("outer_fold"), "selection", "stopping", "refit", "held_out")


@query("single_identity_check", q("SELECT CAST(fold AS BIGINT) AS fold, count(DISTINCT configuration) AS n_identities FROM c_pred GROUP BY fold"))
def single_identity_check(spark, sf):
    out = checks.single_identity(candidates(spark, sf), "fold")
    return out.select(F.col("fold").cast("long").alias("fold"), "n_identities")


@query("missing_configuration_check", q("SELECT name AS configuration FROM (SELECT unnest(['line_words', 'forest', 'dense']) AS name) WHERE name NOT IN (SELECT configuration FROM c_pred)"))
def missing_configuration_check(spark, sf):
    return checks.missing_configurations(candidates(spark, sf), ["line_words", "forest", "dense"])


@query("feature_order_check", q("""
SELECT place, feature, CASE WHEN o = 0 THEN 'unknown' WHEN c > 1 THEN 'repeated' ELSE 'order' END AS problem FROM (
  SELECT *, max(o) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, count(*) OVER (PARTITION BY feature) AS c FROM (
    SELECT n_nationkey AS place, n_name AS feature, CASE WHEN n_nationkey % 5 = 4 THEN 0 ELSE 1 + (n_nationkey * 7) % 25 END AS o FROM nation)) WHERE o = 0 OR c > 1 OR o < prev"""))
def feature_order_check(spark, sf):
    nations = tables.table(spark, sf, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("feature"))
    order = {(r["place"] * 7) % 25: r["feature"] for r in nations.collect() if r["place"] % 5 != 4}
    candidate_order = [order.get(i, f"-{i}") for i in range(25)]
    return checks.feature_selection_order(nations, candidate_order)


@query("diagnostic_package_check", q("""
SELECT 'coverage_total' AS rule, CAST(count(*) AS VARCHAR) AS value FROM s_base UNION ALL SELECT 'case_types', CAST(count(*) FILTER (spread >= q5) AS VARCHAR) FROM c_hits UNION ALL SELECT 'learning_not_empty', '0'"""))
def diagnostic_package_check(spark, sf):
    rows = candidates(spark, sf)
    notable = diagnostics.notable_cases(rows, CANDIDATES)
    wrong = notable.withColumn("case_type", F.when(F.col("case_type") == "divergent_case", "odd_case").otherwise(F.col("case_type")))
    learning = rows.where("fold < 0")
    sensitivity = rows.select(F.lit("eligible").alias("status"))
    return checks.canonical_package(
        diagnostics.coverage(samples_split(spark, sf)), diagnostics.stratified(rows), diagnostics.residual_correlations(rows, CANDIDATES), wrong, learning, sensitivity, 132
    )


# --- scalar rules ---------------------------------------------------------------------------
@query("residual_and_error", q(f"SELECT configuration, sample_id, {sql_r6(RES, 'residual', 4)}, {sql_r6(f'abs({RES})', 'absolute_error', 4)} FROM c_pred"))
def residual_and_error(spark, sf):
    r = fn.residual(F.col("observed"), F.col("predicted"))
    return candidates(spark, sf).select("configuration", "sample_id", r6(r, 4).alias("residual"), r6(F.abs(r), 4).alias("absolute_error"))


@query("effect_classes", q("""
SELECT effect, count(*) AS n FROM (SELECT CASE WHEN d < -1 THEN 'improvement' WHEN d > 1 THEN 'harm' WHEN d IS NULL THEN NULL ELSE 'neutral' END AS effect FROM (
  SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_quantity - 25) / CAST(8 AS DOUBLE) END AS d FROM lineitem)) GROUP BY effect"""))
def effect_classes(spark, sf):
    delta = F.when(F.col("l_linenumber") != 7, (F.col("l_quantity") - 25) / 8.0)
    return tables.table(spark, sf, "lineitem").select(fn.effect_class(delta).alias("effect")).groupBy("effect").agg(F.count("*").alias("n"))


@query("rounding_rules", q("""
SELECT CAST(floor(v + 0.5) AS BIGINT) AS half_up, CAST(round_even(v, 0) AS BIGINT) AS half_even, count(*) AS n FROM (SELECT (l_partkey % 41 - 20) / CAST(4 AS DOUBLE) AS v FROM lineitem) GROUP BY ALL"""))
def rounding_rules(spark, sf):
    v = (F.col("l_partkey") % 41 - 20) / 4.0
    rows = tables.table(spark, sf, "lineitem").select(fn.half_up(v).cast("long").alias("half_up"), fn.half_even(v).cast("long").alias("half_even"))
    return rows.groupBy("half_up", "half_even").agg(F.count("*").alias("n"))


@query("number_text", q("""
SELECT l_orderkey, l_partkey, printf('%.6f', l_extendedprice) AS fixed6, printf('%.4f', l_discount) AS fixed4, printf('%.12g', l_extendedprice / l_quantity) AS significant12, printf('%.12g', l_discount / 1e6) AS small FROM lineitem"""))
def number_text(spark, sf):
    # four formatted texts per row: costly enough to spread a scan that comes in few pieces
    rows = spread(tables.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_quantity"))
    return rows.select(
        "l_orderkey", "l_partkey", fn.fixed(F.col("l_extendedprice")).alias("fixed6"), fn.fixed(F.col("l_discount"), 4).alias("fixed4"),
        fn.significant(F.col("l_extendedprice") / F.col("l_quantity")).alias("significant12"), fn.significant(F.col("l_discount") / 1e6).alias("small"),
    )


@query("permutation_seeds", q("""
SELECT sample_id, CAST('0x' || substr(sha256('42:' || fold || ':area:' || (sample_id % 10)), 1, 8) AS BIGINT) AS seed FROM o_split"""))
def permutation_seeds(spark, sf):
    rows = orders_split(spark, sf)
    return rows.select("sample_id", fn.permutation_seed(42, F.col("fold"), F.lit("area"), F.col("sample_id") % 10).alias("seed"))


@query("finite_parse", q("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN round(value, 4) WHEN event_id % 4 = 2 THEN NULL ELSE round(value, 4) END AS parsed FROM events"""))
def finite_parse(spark, sf):
    rest = F.col("event_id") % 4
    plain = F.format_string("%.6f", "value")
    text = F.when(rest == 0, "abc").when(rest == 1, plain).when(rest == 2, "NaN").otherwise(F.translate(plain, ".", ","))
    parsed = fn.parse_number(text)
    return tables.table(spark, sf, "events").select("event_id", F.round(F.when(fn.finite(parsed), parsed), 4).alias("parsed"))


@query("category_number_order", q("SELECT category, CAST(substr(category, 2) AS BIGINT) AS place, count(*) AS n FROM o_split GROUP BY category"))
def category_number_order(spark, sf):
    rows = orders_split(spark, sf).groupBy("category").agg(F.count("*").alias("n"))
    return rows.select("category", fn.suffix_number(F.col("category")).cast("long").alias("place"), "n").orderBy("place")


fragment("c_json", """
SELECT c_custkey, '{"c_acctbal":"' || printf('%.6f', c_acctbal) || '","c_custkey":"' || c_custkey || '","c_mktsegment":"' || c_mktsegment || '"}' AS j FROM customer""")


@query("canonical_json", q("SELECT c_custkey, j AS json FROM c_json"))
def canonical_json(spark, sf):
    rows = tables.table(spark, sf, "customer")
    return rows.select("c_custkey", fingerprint.canonical_row(rows, ["c_custkey", "c_mktsegment", "c_acctbal"]).alias("json"))


ALIASES = {"1-URGENT": "urgent", "5-LOW": "low"}


@query("configuration_aliases", q("SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS name, count(*) AS n FROM orders GROUP BY 1"))
def configuration_aliases(spark, sf):
    lookup = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    name = F.coalesce(F.element_at(lookup, F.col("o_orderpriority")), F.col("o_orderpriority"))
    return tables.table(spark, sf, "orders").groupBy(name.alias("name")).agg(F.count("*").alias("n"))


@query("wrapped_angles", q("SELECT CAST((((v + 90) % 180) + 180) % 180 - 90 AS DOUBLE) AS angle, count(*) AS n FROM (SELECT CAST(l_partkey % 721 - 360 AS DOUBLE) AS v FROM lineitem) GROUP BY 1"))
def wrapped_angles(spark, sf):
    v = (F.col("l_partkey") % 721 - 360).cast("double")
    return tables.table(spark, sf, "lineitem").groupBy(fn.wrap_angle(v).alias("angle")).agg(F.count("*").alias("n"))


# Terms that a diagnostic text must not use.
PROHIBITED = ["oracle_model", "modelo_oraculo", "p_value", "p-valor", "bootstrap", "stratum_ranking", "ranking_estrato", "causal_claim", "causalidade"]
# Words of the synthetic texts, so that the scan has something to find.
SCANNED = [*PROHIBITED, "license", "copyright", "password"]


@query("prohibited_terms", q("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in SCANNED) + "], lambda x: x IS NOT NULL), ',') AS found FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{t}')" for t in SCANNED)))
def prohibited_terms(spark, sf):
    rows = tables.table(spark, sf, "documents").select("doc_id", fn.contains_any(F.col("text"), SCANNED).alias("found"))
    return rows.where(F.size("found") > 0).select("doc_id", F.array_join("found", ",").alias("found"))


fragment("ep_values", "SELECT vec_id AS k, i, CAST(embedding[i] AS DOUBLE) * 10 AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
fragment("ep_walk", """/*RECURSIVE*/
SELECT k, CAST(0 AS BIGINT) AS i, CAST('inf' AS DOUBLE) AS best, CAST(1 AS BIGINT) AS epoch, CAST(0 AS BIGINT) AS stale FROM (SELECT DISTINCT k FROM ep_values)
UNION ALL SELECT w.k, v.i, CASE WHEN best - v.v > 0.1 THEN v.v ELSE best END, CASE WHEN best - v.v > 0.1 THEN v.i ELSE epoch END, CASE WHEN best - v.v > 0.1 THEN 0 ELSE stale + 1 END
FROM ep_walk w JOIN ep_values v ON v.k = w.k AND v.i = w.i + 1 WHERE stale < 3""")


@query("best_epochs", q("SELECT k AS vec_id, arg_max(epoch, i) AS epoch FROM ep_walk GROUP BY k"))
def best_epochs(spark, sf):
    # the vector of each row stands for its validation curve: a sequence bounded by construction
    curve = F.transform("embedding", lambda v: v.cast("double") * 10)
    return tables.table(spark, sf, "embeddings").select("vec_id", fn.best_epoch(curve, 0.1, 3).cast("long").alias("epoch"))


# --- fingerprints ---------------------------------------------------------------------------
def quarter_sums(h: str) -> str:
    return ", ".join(f"CAST(sum(CAST('0x' || substr({h}, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR) AS q{i}" for i in range(4))


DIGEST = "sha256(n || ':' || q0 || ':' || q1 || ':' || q2 || ':' || q3)"


@query("table_fingerprint", q(f"SELECT 'customer' AS \"table\", n AS rows, {DIGEST} AS digest, 'c_acctbal,c_custkey,c_mktsegment' AS columns FROM (SELECT count(*) AS n, {quarter_sums('sha256(j)')} FROM c_json)"))
def table_fingerprint(spark, sf):
    return fingerprint.table_fingerprint(tables.table(spark, sf, "customer"), "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])


@query("membership_fingerprint", q(f"SELECT CAST(fold AS BIGINT) AS fold, n, {DIGEST} AS digest FROM (SELECT fold, count(*) AS n, {quarter_sums('sha256(CAST(sample_id AS VARCHAR))')} FROM o_split GROUP BY fold)"))
def membership_fingerprint(spark, sf):
    out = fingerprint.membership_fingerprint(orders_split(spark, sf), ["fold"])
    return out.select(F.col("fold").cast("long").alias("fold"), "n", "digest")


@query("file_digests", None)
def file_digests(spark, sf):
    return fingerprint.file_digests(files.list_files(spark, sf), files.file_lines(spark, sf))


@query("split_file_digest", q(f"""
SELECT n AS files, absent, {DIGEST} AS digest FROM (SELECT count(*) AS n, count(*) FILTER (d IS NULL) AS absent, {quarter_sums("sha256(concat_ws(':', name, d))")} FROM (
  SELECT CAST(x.doc_id AS VARCHAR) AS name, CASE WHEN x.doc_id % 9 <> 0 THEN sha256(x.text) END AS d FROM documents x))"""))
def split_file_digest(spark, sf):
    docs = tables.table(spark, sf, "documents")
    contents = docs.where("doc_id % 9 != 0").select(F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("digest"))
    return fingerprint.files_of_split(contents, docs.select(F.col("doc_id").cast("string").alias("name")))


def _fingerprints(spark, sf, changed: bool):
    parts = []
    for name, columns in (("customer", ["c_custkey", "c_acctbal"]), ("part", ["p_partkey", "p_size"]), ("supplier", ["s_suppkey", "s_acctbal"])):
        df = tables.table(spark, sf, name)
        if changed and name == "part":
            df = df.withColumn("p_size", F.col("p_size") + F.when(F.col("p_partkey") == 1, 1).otherwise(0))
        if changed and name == "customer":
            df = df.withColumn("c_name", F.lit("renamed"))
        parts.append(fingerprint.table_fingerprint(df, name, columns))
    return parts


@query("table_freshness", q("SELECT * FROM (SELECT 'customer' AS \"table\", 'reusable' AS status, '' AS differing UNION ALL SELECT 'part', 'obsolete', 'digest' UNION ALL SELECT 'supplier', 'absent', '') WHERE (SELECT count(*) FROM customer) > 0"))
def table_freshness(spark, sf):
    # a change outside the consumed projection (customer names) must not matter
    stored, current = _fingerprints(spark, sf, False), _fingerprints(spark, sf, True)
    return fingerprint.freshness(stored[0].unionByName(stored[1]), current[0].unionByName(current[1]).unionByName(current[2]))


@query("unchanged_inputs", q("SELECT * FROM (SELECT unnest(['customer', 'part', 'supplier']) AS \"table\", 'reusable' AS status, '' AS differing) WHERE (SELECT count(*) FROM part) > 0"))
def unchanged_inputs(spark, sf):
    """Fingerprints stored before are compared with those of the tables as they are read afterwards."""
    before = _fingerprints(spark, sf, False)
    stored, _ = materialize(before[0].unionByName(before[1]).unionByName(before[2]))
    after = _fingerprints(spark, sf, False)
    return fingerprint.freshness(stored, after[0].unionByName(after[1]).unionByName(after[2]))


@query("changed_rows", q("""
SELECT 'orders' AS "table", CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 211 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 211 = 0 OR o_orderkey % 97 = 0
UNION ALL SELECT 'orders', CAST(o_orderkey + 1000000000 AS VARCHAR), 'added' FROM orders WHERE o_orderkey % 301 = 0"""))
def changed_rows(spark, sf):
    """A table that changed during a run: prices, rows that went and rows that came are named, a change outside the projection is not."""
    orders = tables.table(spark, sf, "orders")
    before = fingerprint.remember(orders, "orders", "o_orderkey", ["o_orderkey", "o_totalprice", "o_orderstatus"])
    key = F.col("o_orderkey")
    price = F.when(key % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    came = orders.where(key % 301 == 0).withColumn("o_orderkey", key + 1_000_000_000)
    now, _ = materialize(orders.where(key % 211 != 0).withColumn("o_totalprice", price).unionByName(came).withColumn("o_clerk", F.lit("none")))
    return fingerprint.changed_rows(before, now)


@query("output_records", q(f"SELECT 'nation' AS \"table\", n AS rows, {DIGEST} AS digest, 'n_name,n_nationkey' AS columns FROM (SELECT count(*) AS n, {quarter_sums('sha256(j)')} FROM (SELECT '{{\"n_name\":\"' || n_name || '\",\"n_nationkey\":\"' || n_nationkey || '\"}}' AS j FROM nation))"))
def output_records(spark, sf):
    return fingerprint.table_fingerprint(tables.table(spark, sf, "nation").select("n_nationkey", "n_name"), "nation")


@query("bundle_record_check", q("SELECT 'customer' AS \"table\", count(*) AS rows FROM customer HAVING count(*) <> 132"))
def bundle_record_check(spark, sf):
    record = fingerprint.table_fingerprint(tables.table(spark, sf, "customer"), "customer", ["c_custkey"])
    return record.where(F.col("rows") != 132).select("table", "rows")


fragment("st_edges", "SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier")

@query("stage_descendants", q("""
SELECT a AS ancestor, a AS descendant FROM (SELECT parent AS a FROM st_edges UNION SELECT child FROM st_edges) UNION SELECT parent, child FROM st_edges
UNION SELECT x.parent, y.child FROM st_edges x JOIN st_edges y ON x.child = y.parent"""))
def stage_descendants(spark, sf):
    nations = tables.table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    suppliers = tables.table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.concat(F.lit("s"), "s_suppkey").alias("child"))
    return fingerprint.descendants(nations.unionByName(suppliers))
