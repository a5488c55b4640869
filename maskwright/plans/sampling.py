"""Queries: targets, categories, folds, subsets and their balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import parse_number, r6, suffix_number
from maskwright.operators import checks, split
from maskwright.plans.common import orders_split, samples_split
from maskwright.plans.oracle import fragment, q, r6 as sql_r6
from maskwright.plans.registry import query
from maskwright.sources import tables


@query("target_text_parse", q("""
SELECT o_orderkey AS sample_id, round(TRY_CAST(replace(trim(CASE WHEN o_orderkey % 7 = 0 THEN 'n/a'
  WHEN o_orderkey % 2 = 0 THEN replace(printf('%.2f', o_totalprice), '.', ',') ELSE printf('%.2f', o_totalprice) END), ',', '.') AS DOUBLE), 2) AS target
FROM orders"""))
def target_text_parse(spark, sf):
    text = F.format_string("%.2f", "o_totalprice")
    raw = F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 2 == 0, F.translate(text, ".", ",")).otherwise(text)
    return tables.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.round(parse_number(raw), 2).alias("target")
    )


@query("quantile_category", q("SELECT sample_id, 'B' || cno AS category, target FROM o_split"))
def quantile_category(spark, sf):
    rows = split.quantile_category(tables.samples_large(spark, sf), 10)
    return rows.select("sample_id", F.concat(F.lit("B"), F.col("category_no").cast("string")).alias("category"), "target")


@query("quantile_category_labels", q("""
SELECT cno AS category_no, 'Faixa ' || cno AS label, count(*) AS n, min(target) AS low, max(target) AS high FROM o_split GROUP BY cno"""))
def quantile_category_labels(spark, sf):
    rows = split.quantile_category(tables.samples_large(spark, sf), 10)
    return rows.groupBy(F.col("category_no").cast("long").alias("category_no")).agg(
        F.concat(F.lit("Faixa "), F.max("category_no").cast("string")).alias("label"),
        F.count("*").alias("n"), F.min("target").alias("low"), F.max("target").alias("high"),
    )


@query("stratified_folds", q("SELECT sample_id, category, CAST(fold AS BIGINT) AS fold FROM o_split"))
def stratified_folds(spark, sf):
    return orders_split(spark, sf).select("sample_id", "category", F.col("fold").cast("long").alias("fold"))


@query("global_position", q("SELECT sample_id, row_number() OVER (ORDER BY target, sample_id) - 1 AS position FROM o_base"))
def global_position(spark, sf):
    rows = tables.samples_large(spark, sf).select("sample_id", "target")
    n = rows.count()
    # several ranges even on the small tables, so that the offsets are exercised
    return split.global_position(rows, ["target", "sample_id"], n, max(1, n // 4)).select("sample_id", "position")


@query("outer_fold_roles", q("""
SELECT outer_fold, CASE WHEN fold = outer_fold THEN 'held_out' ELSE 'train' END AS role, count(*) AS n, round(sum(target), 2) AS target_sum
FROM o_split, folds5 GROUP BY ALL"""))
def outer_fold_roles(spark, sf):
    roles = split.outer_roles(orders_split(spark, sf))
    return roles.groupBy(F.col("outer_fold").cast("long").alias("outer_fold"), "role").agg(
        F.count("*").alias("n"), F.round(F.sum("target"), 2).alias("target_sum")
    )


fragment("o_train", "SELECT s.*, f.outer_fold FROM o_split s JOIN folds5 f ON s.fold <> f.outer_fold")
fragment("o_counts", """
SELECT outer_fold, category, count(*) AS n_category, sum(count(*)) OVER (PARTITION BY outer_fold) AS n_all FROM o_train GROUP BY outer_fold, category""")


def _quota(name: str, source: str, count: str, total: str, keys: str = "outer_fold") -> None:
    fragment(name, f"""
SELECT *, base + CASE WHEN rnk <= lft THEN 1 ELSE 0 END AS quota FROM (
  SELECT *, {total} - sum(base) OVER (PARTITION BY {keys}) AS lft, row_number() OVER (PARTITION BY {keys} ORDER BY rest DESC, category) AS rnk FROM (
    SELECT *, CAST({total} AS BIGINT) * CAST({count} AS BIGINT) // CAST(sum({count}) OVER (PARTITION BY {keys}) AS BIGINT) AS base,
      CAST({total} AS BIGINT) * CAST({count} AS BIGINT) % CAST(sum({count}) OVER (PARTITION BY {keys}) AS BIGINT) AS rest FROM {source}))""")


fragment("o_stop_counts", "SELECT *, CAST(ceil(n_all * CAST(0.2 AS DOUBLE)) AS BIGINT) AS n_stop FROM o_counts")
_quota("o_stop_quota", "o_stop_counts", "n_category", "n_stop")
fragment("o_ranked43", """
SELECT *, row_number() OVER (PARTITION BY outer_fold, category ORDER BY sha256('43:' || outer_fold || ':' || sample_id), sample_id) - 1 AS p FROM o_train""")


@query("inner_holdout", q("""
SELECT outer_fold, r.category, CASE WHEN p < quota THEN 'stopping' ELSE 'selection' END AS inner_role, count(*) AS n,
  CAST(sum(r.sample_id) AS BIGINT) AS id_sum
FROM o_ranked43 r JOIN o_stop_quota USING (outer_fold, category) GROUP BY ALL"""))
def inner_holdout(spark, sf):
    rows = split.inner_holdout(orders_split(spark, sf), n=tables.samples_large(spark, sf).count())
    return rows.groupBy(F.col("outer_fold").cast("long").alias("outer_fold"), "category", "inner_role").agg(
        F.count("*").alias("n"), F.sum("sample_id").alias("id_sum")
    )


fragment("o_nest_counts", """
SELECT *, CAST(round_even(n_all * CAST(0.75 AS DOUBLE), 0) AS BIGINT) AS n75, CAST(round_even(n_all * CAST(0.5 AS DOUBLE), 0) AS BIGINT) AS n50 FROM o_counts""")
_quota("o_q75", "o_nest_counts", "n_category", "n75")
fragment("o_q75r", "SELECT outer_fold, category, n50, quota AS q75 FROM o_q75")
_quota("o_q50", "o_q75r", "q75", "n50")
fragment("o_ranked45", """
SELECT *, row_number() OVER (PARTITION BY outer_fold, category ORDER BY sha256('45:' || outer_fold || ':' || sample_id), sample_id) - 1 AS p FROM o_train""")


@query("nested_subsets", q("""
SELECT outer_fold, fraction, count(*) AS n, CAST(sum(sample_id) AS BIGINT) AS id_sum FROM (
  SELECT r.outer_fold, r.sample_id, unnest(CASE WHEN p < quota THEN [0.5, 0.75, 1.0]::DOUBLE[] WHEN p < q75 THEN [0.75, 1.0]::DOUBLE[] ELSE [1.0]::DOUBLE[] END) AS fraction
  FROM o_ranked45 r JOIN o_q50 USING (outer_fold, category)) GROUP BY ALL"""))
def nested_subsets(spark, sf):
    rows = split.nested_subsets(orders_split(spark, sf), n=tables.samples_large(spark, sf).count())
    return rows.groupBy(F.col("outer_fold").cast("long").alias("outer_fold"), "fraction").agg(
        F.count("*").alias("n"), F.sum("sample_id").alias("id_sum")
    )


fragment("o_frac_counts", """
SELECT *, CAST(floor(n_all * fraction) AS BIGINT) AS n_take FROM o_counts, (SELECT unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS fraction)""")
_quota("o_frac_quota", "o_frac_counts", "n_category", "n_take", "outer_fold, fraction")
fragment("o_ranked42", """
SELECT *, row_number() OVER (PARTITION BY outer_fold, category ORDER BY sha256('42:' || outer_fold || ':' || sample_id), sample_id) - 1 AS p FROM o_train""")


@query("fraction_subsets", q("""
SELECT r.outer_fold, fraction, count(*) AS n, CAST(sum(sample_id) AS BIGINT) AS id_sum
FROM o_ranked42 r JOIN o_frac_quota USING (outer_fold, category) WHERE p < quota GROUP BY ALL"""))
def fraction_subsets(spark, sf):
    rows = split.fraction_subsets(orders_split(spark, sf), n=tables.samples_large(spark, sf).count())
    return rows.groupBy(F.col("outer_fold").cast("long").alias("outer_fold"), "fraction").agg(
        F.count("*").alias("n"), F.sum("sample_id").alias("id_sum")
    )


@query("repeated_splits", q("""
SELECT CAST(split_seed AS BIGINT) AS split_seed, CAST(fold AS BIGINT) AS fold, count(*) AS n, CAST(sum(sample_id) AS BIGINT) AS id_sum FROM (
  SELECT sample_id, split_seed, (row_number() OVER (PARTITION BY split_seed ORDER BY cno, sha256(split_seed || ':' || sample_id), sample_id) - 1) % 5 + 1 AS fold
  FROM o_split, (SELECT unnest([0, 1, 2]) AS split_seed)) GROUP BY ALL"""))
def repeated_splits(spark, sf):
    rows = split.repeated_splits(tables.samples_large(spark, sf), (0, 1, 2))
    return rows.groupBy(F.col("split_seed").cast("long").alias("split_seed"), F.col("fold").cast("long").alias("fold")).agg(
        F.count("*").alias("n"), F.sum("sample_id").alias("id_sum")
    )


@query("distribution_points", q("""
SELECT CAST(sample_id AS VARCHAR) AS file_name, grp, target, category, 'Faixa ' || cno AS label,
  """ + sql_r6("cno + (list_sum(list_transform(string_split(CAST(sample_id AS VARCHAR), ''), lambda c: ascii(c))) % 21 - 10) / 100.0", "x") + " FROM o_split"))
def distribution_points(spark, sf):
    name = F.col("sample_id").cast("string")
    codes = F.aggregate(F.split(name, ""), F.lit(0), lambda acc, c: acc + F.ascii(c))
    number = suffix_number(F.col("category"))
    x = number + (F.pmod(codes, F.lit(21)) - 10) / 100.0
    return orders_split(spark, sf).select(
        name.alias("file_name"), "grp", "target", "category",
        F.concat(F.lit("Faixa "), number.cast("string")).alias("label"), r6(x).alias("x"),
    )


# folds dealt by id alone, which the check must find out of balance
fragment("o_naive", "SELECT sample_id, category, sample_id % 5 + 1 AS fold FROM o_split")


@query("split_balance", q("""
SELECT scope, CAST(fold AS BIGINT) AS fold, category, n, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high FROM (
  SELECT 'category' AS scope, NULL AS fold, category, count(*) AS n, floor((SELECT count(*) FROM o_naive) / 10.0) AS low, ceil((SELECT count(*) FROM o_naive) / 10.0) AS high FROM o_naive GROUP BY category
  UNION ALL SELECT 'fold', fold, NULL, count(*), floor((SELECT count(*) FROM o_naive) / 5.0), ceil((SELECT count(*) FROM o_naive) / 5.0) FROM o_naive GROUP BY fold
  UNION ALL SELECT 'cell', fold, category, count(*), floor(c / 5.0), ceil(c / 5.0) FROM (SELECT fold, category, count(*) OVER (PARTITION BY category) AS c FROM o_naive) GROUP BY fold, category, c)
WHERE n < low OR n > high"""))
def split_balance(spark, sf):
    naive = orders_split(spark, sf).withColumn("fold", (F.pmod("sample_id", F.lit(5)) + 1).cast("int"))
    return checks.split_balance(naive, 10, 5)


@query("category_profile", q("""
SELECT category, count(*) AS n, min(target) AS low, max(target) AS high, """ + sql_r6("avg(target)", "mean", 4) + ", " + sql_r6("quantile_cont(target, 0.5)", "median", 4) + ", " + sql_r6("stddev_samp(target)", "sd", 4) + ", count(DISTINCT grp) AS n_groups FROM s_split GROUP BY category"))
def category_profile(spark, sf):
    from maskwright.operators.metrics import category_profile as profile

    rows = profile(samples_split(spark, sf))
    return rows.select("category", "n", "low", "high", *[r6(F.col(c), 4).alias(c) for c in ("mean", "median", "sd")], "n_groups")


@query("fold_profile", q("""
SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n, min(target) AS low, max(target) AS high, """ + sql_r6("avg(target)", "mean", 4) + ", " + sql_r6("quantile_cont(target, 0.5)", "median", 4) + ", " + sql_r6("stddev_samp(target)", "sd", 4) + ", count(DISTINCT grp) AS n_groups FROM s_split GROUP BY fold"))
def fold_profile(spark, sf):
    from maskwright.operators.metrics import category_profile as profile

    rows = profile(samples_split(spark, sf).withColumn("fold", F.col("fold").cast("long")), "fold")
    return rows.select("fold", "n", "low", "high", *[r6(F.col(c), 4).alias(c) for c in ("mean", "median", "sd")], "n_groups")
