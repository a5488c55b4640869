"""Queries: similar masks, contradictions and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import r6
from maskwright.operators import aligned, pose, runs, similarity
from maskwright.operators import neighbours as search
from maskwright.plans import forms, poses  # noqa: F401  (their SQL fragments are used below)
from maskwright.plans.features import FEATURES, SMALL, mask_feature_table
from maskwright.plans.poses import canonical_fragments, resize_fragment
from maskwright.plans.oracle import fragment, q, r6 as sql_r6
from maskwright.plans.registry import query
from maskwright.plans.shapes import grid_runs
from maskwright.session import materialize
from maskwright.sources import tables

fragment("d_box", "SELECT mask_id, sum(x1 - x0 + 1) AS a FROM c64_runs GROUP BY mask_id")
fragment("d_inter", """
SELECT a.mask_id AS a, b.mask_id AS b, sum(least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1) AS inter FROM c64_runs a JOIN c64_runs b ON a.y = b.y AND a.mask_id < b.mask_id AND a.x0 <= b.x1 AND b.x0 <= a.x1 GROUP BY ALL""")
fragment("d_iou", "SELECT i.a, i.b, CAST(inter AS DOUBLE) / (x.a + y.a - inter) AS iou FROM d_inter i JOIN d_box x ON x.mask_id = i.a JOIN d_box y ON y.mask_id = i.b")


def aligned_masks(spark, sf):
    """The silhouettes turned upright on 64 x 64 rasters, stored once."""
    return materialize(aligned.canonical_bits(forms.shapes(spark, sf)))[0]


fragment("g_vec", "SELECT mask_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY k) AS vec FROM f_long GROUP BY mask_id")
fragment("v_digest", "SELECT mask_id, string_agg(side || '|' || y || ':' || x0 || '-' || x1, ';' ORDER BY y, x0) AS digest FROM v_runs GROUP BY mask_id")
fragment("d_digest", "SELECT mask_id, string_agg(y || ':' || x0 || '-' || x1, ';' ORDER BY y, x0) AS digest FROM c64_runs GROUP BY mask_id")
fragment("d_content", "SELECT mask_id, min(mask_id) OVER (PARTITION BY digest) AS content FROM d_digest")


@query("similar_masks", q("SELECT a, b, " + sql_r6("iou", "iou") + " FROM d_iou JOIN d_content ca ON ca.mask_id = a AND ca.content = a JOIN d_content cb ON cb.mask_id = b AND cb.content = b WHERE iou >= 0.85"))
def similar_masks(spark, sf):
    """Pairs of different aligned rasters, each by its smallest mask, with IoU of at least 0.85."""
    masks = aligned_masks(spark, sf)
    first = masks.groupBy("bits").agg(F.min("mask_id").alias("mask_id")).select("mask_id")
    pairs, _ = aligned.similar(masks.join(first, "mask_id", "left_semi"), 0.85)
    return pairs.select("a", "b", r6(F.col("iou")).alias("iou"))


@query("mask_integrity", q(f"""
SELECT 'duplicate_names' AS test, CAST(0 AS DOUBLE) AS value FROM (SELECT 1)
UNION ALL SELECT 'duplicate_masks', count(*) - count(DISTINCT digest) FROM v_digest
UNION ALL SELECT 'duplicate_feature_vectors', (SELECT count(*) FROM g_vec) - (SELECT count(*) FROM (SELECT DISTINCT vec FROM g_vec))
UNION ALL SELECT 'near_duplicate_pairs', count(*) FILTER (iou >= 0.95) FROM d_iou
UNION ALL SELECT 'maximum_iou', round(max(iou), 6) FROM d_iou"""))
def mask_integrity(spark, sf):
    masks = aligned_masks(spark, sf)
    out = aligned.integrity(runs.digests(forms.shapes(spark, sf)), masks, mask_feature_table(spark, sf))
    return out.select("test", F.round("value", 6).alias("value"))


fragment("d_scored", """
SELECT i.a AS id_a, i.b AS id_b, abs(x.target - y.target) AS target_difference, iou, abs(x.target - y.target) * iou AS score FROM d_iou i JOIN m_base x ON x.mask_id = i.a JOIN m_base y ON y.mask_id = i.b""")


@query("contradicting_masks", q("SELECT id_a, id_b, target_difference, " + sql_r6("iou", "iou") + ", " + sql_r6("score", "score", 2) + " FROM d_scored ORDER BY d_scored.score DESC, id_a DESC, id_b DESC LIMIT 20"))
def contradicting_masks(spark, sf):
    targets = tables.mask_targets(spark, sf).select(F.col("sample_id").alias("mask_id"), "target")
    rows = aligned.contradictions(aligned_masks(spark, sf), targets, 20)
    return rows.select("id_a", "id_b", "target_difference", r6(F.col("iou")).alias("iou"), r6(F.col("score"), 2).alias("score"))


fragment("n_stats", "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in SMALL) + " FROM s_base")
fragment("n_vec", "SELECT sample_id, target, " + ", ".join(f"({c} - m_{c}) / CASE WHEN d_{c} = 0 THEN 1 ELSE d_{c} END AS z_{c}" for c in SMALL) + " FROM s_base, n_stats")
fragment("n_best", "SELECT a.sample_id, min({'r': round(sqrt(" + " + ".join(f"pow(a.z_{c} - b.z_{c}, 2)" for c in SMALL) + "), 7), 'o': b.sample_id}) AS best FROM n_vec a JOIN n_vec b ON a.sample_id <> b.sample_id GROUP BY a.sample_id")
fragment("n_pairs", """
SELECT least(n.sample_id, best.o) AS id_a, greatest(n.sample_id, best.o) AS id_b, max(best.r) AS distance FROM n_best n GROUP BY ALL""")
fragment("n_diff", "SELECT p.*, a.target AS target_a, b.target AS target_b, abs(a.target - b.target) AS target_difference FROM n_pairs p JOIN s_base a ON a.sample_id = id_a JOIN s_base b ON b.sample_id = id_b")


def neighbours(spark, sf):
    rows = tables.samples(spark, sf, tuple(SMALL))
    # the feature table is read by the statistics, the copies and the search
    stored, _ = materialize(rows.select("sample_id", "target", *SMALL))
    return search.nearest_neighbours(similarity.standardized_vectors(stored, SMALL, "sample_id"), "sample_id"), stored


@query("nearest_neighbours", q("SELECT sample_id, best.o AS neighbour, round(best.r + 1e-9, 5) + 0.0 AS distance FROM n_best"))
def nearest_neighbours(spark, sf):
    found, _ = neighbours(spark, sf)
    return found.select("sample_id", "neighbour", r6(F.round("distance", 7), 5).alias("distance"))


@query("neighbour_pairs", q("SELECT id_a, id_b, round(distance + 1e-9, 5) + 0.0 AS distance, target_difference FROM n_diff"))
def neighbour_pairs(spark, sf):
    found, stored = neighbours(spark, sf)
    pairs = similarity.neighbour_pairs(found, stored, "sample_id")
    return pairs.select("id_a", "id_b", r6(F.round("distance", 7), 5).alias("distance"), "target_difference")


@query("neighbour_summary", q("SELECT count(*) AS n, " + ", ".join([sql_r6("avg(target_difference)", "mean_difference", 4), sql_r6("quantile_cont(target_difference, 0.5)", "median_difference", 4), sql_r6("quantile_cont(target_difference, 0.9)", "p90_difference", 4)]) + " FROM n_diff"))
def neighbour_summary(spark, sf):
    found, stored = neighbours(spark, sf)
    out = similarity.neighbour_summary(similarity.neighbour_pairs(found, stored, "sample_id"))
    return out.select("n", *[r6(F.col(c), 4).alias(c) for c in ("mean_difference", "median_difference", "p90_difference")])


@query("neighbour_contradictions", q("SELECT id_a, id_b, target_difference FROM n_diff ORDER BY target_difference / greatest(distance, 1e-9) DESC, id_a, id_b LIMIT 20"))
def neighbour_contradictions(spark, sf):
    found, stored = neighbours(spark, sf)
    pairs = similarity.neighbour_pairs(found, stored, "sample_id").withColumn("distance", F.round("distance", 7))
    return similarity.ranked_contradictions(pairs, 20).select("id_a", "id_b", "target_difference")


# --- neighbours among masks: the 26 measurements, and these with the components of two rasters -----
fragment("mn_stats", "SELECT k, avg(v) AS m, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS d FROM f_long GROUP BY k")
fragment("mn_vec", "SELECT mask_id, list((v - m) / d ORDER BY k) AS z FROM f_long JOIN mn_stats USING (k) GROUP BY mask_id")
fragment("mn_best", """
SELECT a.mask_id, min({'r': round(sqrt(list_sum(list_transform(range(1, 27), lambda i: pow(a.z[i] - b.z[i], 2)))), 7), 'o': b.mask_id}) AS best FROM mn_vec a JOIN mn_vec b ON a.mask_id <> b.mask_id GROUP BY a.mask_id""")


@query("mask_neighbours", q("SELECT mask_id, best.o AS neighbour, round(best.r + 1e-9, 5) + 0.0 AS distance FROM mn_best"))
def mask_neighbours(spark, sf):
    """The nearest other mask of every mask in all 26 standardised measurements."""
    found = search.nearest_neighbours(similarity.standardized_vectors(mask_feature_table(spark, sf), FEATURES, "mask_id"), "mask_id")
    return found.select("mask_id", "neighbour", r6(F.round("distance", 7), 5).alias("distance"))


def mask_rasters(spark, sf, side=96):
    """Stretched and aligned rasters of the silhouettes, stored once."""
    shapes = forms.shapes(spark, sf)
    raw, _ = materialize(aligned.packed(pose.resize(shapes, side, "stretch"), side))
    canonical, _ = materialize(aligned.canonical_bits(shapes, side, max(4 * side, aligned.WORKING)))
    return raw, canonical


PARTS = {"raw": 24, "canonical": 16}
resize_fragment("r96", 96, "96", "96", 0)
canonical_fragments("c96", "v_cells", "v_box", 96)
for _name, _cells in (("raw", "r96_cells"), ("canonical", "c96_cells")):
    fragment(f"t_{_name}", f"SELECT sum(p * (1 - p)) AS total FROM (SELECT y, x, count(*) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE) AS p FROM {_cells} GROUP BY y, x)")


fragment("t_bits", "SELECT mask_id, y * 8 + x AS i, CAST(lit AS INT) AS v FROM g_all64")
fragment("t_square", "SELECT sum(c * c) AS f FROM (SELECT covar_pop(a.v, b.v) AS c FROM t_bits a JOIN t_bits b USING (mask_id) GROUP BY a.i, b.i)")
fragment("t_grid", "SELECT sum(c) AS total FROM (SELECT var_pop(v) AS c FROM t_bits GROUP BY i)")


@query("raster_components", q("""
SELECT u.raster, u.k AS parts, """ + sql_r6("CASE u.raster WHEN 'grid' THEN (SELECT total FROM t_grid) WHEN 'raw' THEN (SELECT total FROM t_raw) ELSE (SELECT total FROM t_canonical) END", "total_variance", 5) + ", " + sql_r6("CASE u.raster WHEN 'grid' THEN (SELECT f FROM t_square) END", "sum_of_squares", 6) + """, TRUE AS falling, TRUE AS within
FROM (SELECT unnest(['grid', 'raw', 'canonical']) AS raster, unnest([CAST(64 AS BIGINT), 24, 16]) AS k) AS u"""))
def raster_components(spark, sf):
    """Components of the 96 x 96 rasters and, all of them, of the 8 x 8 grids.

    Their number, the variance of all cells, and what must hold: the squares of all variances add up to those of the
    whole covariance matrix (grids), variances fall and do not exceed the total.
    """
    rows = []
    grid = materialize(aligned.packed(grid_runs(spark, sf), tables.GRID_SIDE))[0]
    for name, k, side, bits in zip(("grid", *PARTS), (64, *PARTS.values()), (8, 96, 96), (grid, *mask_rasters(spark, sf))):
        c = search.principal_components(bits, k, side * side)
        falling = bool((c.variances[1:] <= c.variances[:-1] + 1e-9).all())
        squares = float((c.variances**2).sum()) if name == "grid" else None
        rows.append((name, len(c.variances), c.total, squares, falling, bool(c.variances.sum() <= c.total * (1 + 1e-9))))
    out = spark.createDataFrame(rows, "raster string, parts long, total_variance double, sum_of_squares double, falling boolean, within boolean")
    return out.withColumn("total_variance", r6(F.col("total_variance"), 5)).withColumn("sum_of_squares", r6(F.col("sum_of_squares"), 6))


@query("representation_neighbours", None)
def representation_neighbours(spark, sf):
    """The nearest other mask in the full representation: 26 measurements, 24 and 16 components (tests/test_neighbours.py has the brute force)."""
    raw, canonical = mask_rasters(spark, sf)
    vectors = search.full_representation(mask_feature_table(spark, sf), FEATURES, raw, canonical)
    return search.nearest_neighbours(vectors, "mask_id").select("mask_id", "neighbour", F.round("distance", 4).alias("distance"))
