"""Queries: run tables and silhouette measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import r6
from maskwright.operators import geometry, runs
from maskwright.plans.oracle import fragment, q, r6 as sql_r6
from maskwright.plans.registry import query
from maskwright.sources import tables

fragment("g_cells", """
SELECT vec_id AS mask_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) WHERE embedding[i] > 0""")
fragment("g_runs", """
SELECT mask_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY mask_id, y ORDER BY x) AS g FROM g_cells) GROUP BY mask_id, y, g""")
fragment("v_rows", "SELECT mask_id, 1 + mask_id % 4 AS m, y AS r, min(x) AS lo, max(x) AS hi FROM g_cells GROUP BY mask_id, y")
fragment("v_runs", """
SELECT mask_id, 40 + m AS side, m + 4 * r + k AS y, m + 4 * lo AS x0, m + 4 * hi + 3 AS x1 FROM (SELECT *, unnest(range(0, 4)) AS k FROM v_rows)""")
fragment("v_cells", "SELECT mask_id, side, y, unnest(range(x0, x1 + 1)) AS x FROM v_runs")


def cell_measures(cells: str, name: str) -> None:
    """SQL definitions of the measurements straight from cells, not from runs."""
    fragment(f"{name}_box", f"SELECT mask_id, min(x) AS l, max(x) AS rr, min(y) AS t, max(y) AS b, count(*) AS a FROM {cells} GROUP BY mask_id")
    fragment(f"{name}_pairs", f"""
SELECT c.mask_id, count(*) FILTER (e.x IS NULL) AS runs, count(s.x) AS n0, count(d1.x) AS n1, count(d2.x) AS nm
FROM {cells} c LEFT JOIN {cells} e ON e.mask_id = c.mask_id AND e.y = c.y AND e.x = c.x - 1
LEFT JOIN {cells} s ON s.mask_id = c.mask_id AND s.y = c.y + 1 AND s.x = c.x
LEFT JOIN {cells} d1 ON d1.mask_id = c.mask_id AND d1.y = c.y + 1 AND d1.x = c.x + 1
LEFT JOIN {cells} d2 ON d2.mask_id = c.mask_id AND d2.y = c.y + 1 AND d2.x = c.x - 1 GROUP BY c.mask_id""")
    fragment(f"{name}_mom", f"""
SELECT mask_id, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vxx, var_pop(y) AS vyy, covar_pop(x, y) AS vxy FROM {cells} GROUP BY mask_id""")
    fragment(f"{name}_cols", f"""
SELECT g.mask_id, g.x, (SELECT 1) AS one, g.rn, count(c.y) AS n, g.w FROM (
  SELECT mask_id, unnest(range(l, rr + 1)) AS x, unnest(range(0, rr - l + 1)) AS rn, rr - l + 1 AS w FROM {name}_box) g
LEFT JOIN {cells} c ON c.mask_id = g.mask_id AND c.x = g.x GROUP BY ALL""")
    fragment(f"{name}_thirds", f"""
SELECT mask_id, coalesce(avg(n) FILTER (k = 0), 0) AS o0, coalesce(avg(n) FILTER (k = 1), 0) AS o1, coalesce(avg(n) FILTER (k = 2), 0) AS o2 FROM (
  SELECT *, CASE WHEN rn < w // 3 + CAST(w % 3 > 0 AS INT) THEN 0 WHEN rn < 2 * (w // 3) + CAST(w % 3 > 0 AS INT) + CAST(w % 3 > 1 AS INT) THEN 1 ELSE 2 END AS k FROM {name}_cols)
GROUP BY mask_id""")
    fragment(f"{name}_ext", f"SELECT mask_id, y, min(x) AS lo, max(x) AS hi FROM {cells} GROUP BY mask_id, y")
    fragment(f"{name}_hrows", f"""
SELECT p.mask_id, r.y, CAST(ceil(min(CAST(p.lo * (q.y - r.y) + q.lo * (r.y - p.y) AS DOUBLE) / (q.y - p.y)) - 1e-9) AS BIGINT) AS x0,
  CAST(floor(max(CAST(p.hi * (q.y - r.y) + q.hi * (r.y - p.y) AS DOUBLE) / (q.y - p.y)) + 1e-9) AS BIGINT) AS x1
FROM {name}_ext p JOIN {name}_ext q ON p.mask_id = q.mask_id AND p.y < q.y
JOIN (SELECT mask_id, unnest(range(t, b + 1)) AS y FROM {name}_box) r ON r.mask_id = p.mask_id AND r.y BETWEEN p.y AND q.y GROUP BY p.mask_id, r.y""")
    fragment(f"{name}_hull", f"""
SELECT h.mask_id, sum(h.x1 - h.x0 + 1) AS ha, count(*) AS hr,
  sum(CASE WHEN n.y IS NULL THEN 0 ELSE greatest(0, least(h.x1, n.x1) - greatest(h.x0, n.x0) + 1) END) AS h0, sum(CASE WHEN n.y IS NULL THEN 0 ELSE greatest(0, least(h.x1, n.x1 - 1) - greatest(h.x0, n.x0 - 1) + 1) END) AS h1,
  sum(CASE WHEN n.y IS NULL THEN 0 ELSE greatest(0, least(h.x1, n.x1 + 1) - greatest(h.x0, n.x0 + 1) + 1) END) AS hm
FROM {name}_hrows h LEFT JOIN {name}_hrows n ON n.mask_id = h.mask_id AND n.y = h.y + 1 GROUP BY h.mask_id""")
    fragment(f"{name}_feret", f"""
SELECT p.mask_id, max(sqrt(pow(p.y - q.y, 2) + pow(greatest(abs(p.hi - q.lo), abs(q.hi - p.lo)), 2))) AS feret FROM {name}_ext p JOIN {name}_ext q USING (mask_id) GROUP BY p.mask_id""")
    fragment(f"{name}_all", f"""
SELECT x.mask_id, CAST(a AS DOUBLE) AS area, pi() / 8 * (2 * runs + 2 * a - 2 * n0 + (4 * a - 2 * n1 - 2 * nm) / sqrt(2)) AS perimeter,
  rr - l + 1 AS bw, b - t + 1 AS bh, mx, my, vxx, vyy, vxy, l, t, o0, o1, o2, feret, ha,
  pi() / 8 * (2 * hr + 2 * ha - 2 * coalesce(h0, 0) + (4 * ha - 2 * coalesce(h1, 0) - 2 * coalesce(hm, 0)) / sqrt(2)) AS hp,
  4 * sqrt(greatest((vxx + vyy) / 2 + sqrt(pow((vxx - vyy) / 2, 2) + vxy * vxy), 0)) AS major,
  4 * sqrt(greatest((vxx + vyy) / 2 - sqrt(pow((vxx - vyy) / 2, 2) + vxy * vxy), 0)) AS minor
FROM {name}_box x JOIN {name}_pairs USING (mask_id) JOIN {name}_mom USING (mask_id) JOIN {name}_thirds USING (mask_id) JOIN {name}_feret USING (mask_id) LEFT JOIN {name}_hull USING (mask_id)""")


cell_measures("g_cells", "g")
cell_measures("v_cells", "v")
FEATURE_SQL = {
    "area": "area", "perimeter": "perimeter", "solidity": "area / ha", "circularity": "4 * pi() * area / (perimeter * perimeter)",
    "equivalent_diameter": "sqrt(4 * area / pi())", "bbox_width": "bw", "bbox_height": "bh", "bbox_area": "bw * bh",
    "aspect_ratio": "CAST(bw AS DOUBLE) / bh", "extent": "area / (bw * bh)", "convex_area": "ha", "convexity": "hp / perimeter",
    "major_axis_length": "major", "minor_axis_length": "minor", "roundness": "4 * area / (pi() * major * major)", "feret_diameter": "feret",
    "hu_moment_1": "(vxx + vyy) / area", "hu_moment_2": "pow((vxx - vyy) / area, 2) + 4 * pow(vxy / area, 2)",
    "area_power_1_5": "pow(area, 1.5)", "area_major_axis_product": "area * major", "center_vertical_occupancy": "o1",
    "end_vertical_occupancy_min": "least(o0, o2)", "end_vertical_occupancy_max": "greatest(o0, o2)",
    "center_to_end_occupancy_ratio": "CASE WHEN o0 + o2 = 0 THEN 0 ELSE o1 / ((o0 + o2) / 2) END",
    "centroid_x_offset": "abs((mx - l + 0.5) / bw - 0.5)", "centroid_y_ratio": "(my - t + 0.5) / bh",
}


def feature_sql(names, scale: str | None = None, digits: int = 5) -> str:
    def one(f):
        dim = geometry.DIMENSION.get(f, 0)
        return sql_r6(f"({FEATURE_SQL[f]})" + (f" * pow({scale}, {dim})" if scale and dim else ""), f, digits)

    return ", ".join(one(f) for f in names)


def grid_runs(spark, sf):
    return runs.bits_to_runs(tables.grid_bits(spark, sf))


def selected(df, names, digits=5):
    return df.select("mask_id", *[r6(F.col(f), digits).alias(f) for f in names])


@query("mask_runs", q("SELECT mask_id, y, x0, x1 FROM g_runs"))
def mask_runs(spark, sf):
    rows = runs.cells_to_runs(tables.grid_cells(spark, sf))
    return rows.select("mask_id", *[F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")])


@query("mask_runs_from_bits", q("SELECT mask_id, y, x0, x1 FROM g_runs"))
def mask_runs_from_bits(spark, sf):
    return grid_runs(spark, sf).select("mask_id", *[F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")])


@query("mask_resolution", q("SELECT vec_id AS mask_id, '8x8' AS resolution, CAST(len(embedding) AS BIGINT) AS n_cells FROM embeddings"))
def mask_resolution(spark, sf):
    bits = tables.grid_bits(spark, sf)
    return bits.select("mask_id", F.concat_ws("x", F.col("w").cast("string"), F.col("h").cast("string")).alias("resolution"), F.size("bits").cast("long").alias("n_cells"))


@query("mask_features", q("SELECT mask_id, " + feature_sql(geometry.FEATURES) + " FROM g_all"))
def mask_features(spark, sf):
    return selected(geometry.mask_features(tables.grid_bits(spark, sf), grid_runs(spark, sf)), geometry.FEATURES)


@query("mask_features_scaled", q("SELECT mask_id, " + feature_sql(geometry.FEATURES, "1024.0 / (41 + mask_id % 4)", 3) + " FROM v_all"))
def mask_features_scaled(spark, sf):
    shapes = tables.silhouette_runs(spark, sf)
    dims = shapes.select("mask_id", "h", "w").distinct()
    return selected(geometry.mask_features(dims, shapes, 1024), geometry.FEATURES, 3)


def _group(name: str, features: list[str]) -> None:
    hull = any(f in geometry.HULL_FEATURES for f in features)

    @query(name, q("SELECT mask_id, " + feature_sql(features) + " FROM v_all"))
    def run(spark, sf):
        return selected(geometry.measure(tables.silhouette_runs(spark, sf), with_hull=hull), features)


_group("mask_area", ["area", "area_power_1_5", "equivalent_diameter"])
_group("mask_bounding_box", ["bbox_width", "bbox_height", "bbox_area", "aspect_ratio", "extent"])
_group("mask_perimeter", ["perimeter", "circularity"])
_group("mask_axes", ["major_axis_length", "minor_axis_length", "roundness", "area_major_axis_product"])
_group("mask_hu_moments", ["hu_moment_1", "hu_moment_2"])
_group("mask_convexity", ["convex_area", "solidity", "convexity"])
_group("mask_feret_diameter", ["feret_diameter"])
_group("mask_occupancy", ["center_vertical_occupancy", "end_vertical_occupancy_min", "end_vertical_occupancy_max", "center_to_end_occupancy_ratio"])
_group("mask_centroid", ["centroid_x_offset", "centroid_y_ratio"])


@query("mask_moments", q("SELECT mask_id, " + ", ".join(sql_r6(e, n, 5) for n, e in (("moment_xx", "vxx"), ("moment_yy", "vyy"), ("moment_xy", "vxy"), ("mean_x", "mx"), ("mean_y", "my"))) + " FROM g_all"))
def mask_moments(spark, sf):
    return selected(geometry.measure(grid_runs(spark, sf), with_hull=False), ["moment_xx", "moment_yy", "moment_xy", "mean_x", "mean_y"])


@query("mask_hull_runs", q("SELECT mask_id, y, x0, x1 FROM g_hrows WHERE x0 <= x1"))
def mask_hull_runs(spark, sf):
    rows = geometry.hull_runs(grid_runs(spark, sf))
    return rows.select("mask_id", *[F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")])


@query("mask_hull_vertices", None)
def mask_hull_vertices(spark, sf):
    rows = geometry.measure(grid_runs(spark, sf)).select("mask_id", F.inline("hull_vertices"))
    return rows.select("mask_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query("mask_principal_angle", q("SELECT mask_id, " + sql_r6(
    "(((degrees(0.5 * atan2(2 * vxy, vxx - vyy)) + 90) % 180) + 180) % 180 - 90", "angle", 5) + " FROM v_all"))
def mask_principal_angle(spark, sf):
    measured = geometry.measure(tables.silhouette_runs(spark, sf), with_hull=False)
    return measured.select("mask_id", r6(geometry.principal_angle(measured), 5).alias("angle"))
