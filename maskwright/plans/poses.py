"""Queries: resizing, pose and channels of masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import r6
from maskwright.operators import aligned, pose
from maskwright.plans import forms
from maskwright.plans.oracle import fragment, q, r6 as sql_r6
from maskwright.plans.registry import query
from maskwright.plans.shapes import grid_runs
from maskwright.sources import tables


def wide_runs(spark, sf):
    """The silhouettes on frames that are wider than tall, so that letterboxing adds borders."""
    return tables.silhouette_runs(spark, sf).withColumn("w", F.col("w") + 20)


def resize_fragment(name: str, side: int, height: str, width: str, wider: int = 20) -> None:
    """Cell by cell: every destination cell reads its nearest source cell; frames are `wider` than tall."""
    fragment(f"{name}_cells", f"""
SELECT d.mask_id, d.y + ({side} - hh) // 2 AS y, d.x + ({side} - ww) // 2 AS x FROM (
  SELECT mask_id, hh, ww, y, x, (2 * y + 1) * side // (2 * hh) AS sy, (2 * x + 1) * (side + {wider}) // (2 * ww) AS sx FROM (
    SELECT *, unnest(range(0, ww)) AS x FROM (SELECT *, unnest(range(0, hh)) AS y FROM (
      SELECT DISTINCT mask_id, side, CAST({height} AS BIGINT) AS hh, CAST({width} AS BIGINT) AS ww FROM v_cells)))) d
JOIN v_cells c ON c.mask_id = d.mask_id AND c.y = d.sy AND c.x = d.sx""")
    fragment(f"{name}_runs", f"""
SELECT mask_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY mask_id, y ORDER BY x) AS g FROM {name}_cells) GROUP BY mask_id, y, g""")


resize_fragment("lb", 24, "greatest(round_even(side * CAST(24 AS DOUBLE) / (side + 20), 0), 1)", "24")
resize_fragment("st", 96, "96", "96")


@query("mask_letterbox", q("SELECT mask_id, y, x0, x1 FROM lb_runs"))
def mask_letterbox(spark, sf):
    return forms.long_runs(pose.resize(wide_runs(spark, sf), 24))


@query("mask_stretch", q("SELECT mask_id, y, x0, x1 FROM st_runs"))
def mask_stretch(spark, sf):
    return forms.long_runs(pose.resize(wide_runs(spark, sf), 96, "stretch"))


def canonical_fragments(name: str, cells: str, box: str, side: int) -> None:
    """Cell by cell: turn by the angle from integer sums, crop, letterbox to side x side."""
    fragment(f"{name}_sums", f"""
SELECT mask_id, CAST(a AS DOUBLE) AS a, sx / CAST(a AS DOUBLE) AS cx, sy / CAST(a AS DOUBLE) AS cy, CASE WHEN a > 1 THEN 0.5 * atan2(CAST(2 * (a * xy - sx * sy) AS DOUBLE), CAST((a * xx - sx * sx) - (a * yy - sy * sy) AS DOUBLE)) ELSE 0 END AS t FROM (
  SELECT mask_id, count(*) AS a, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy, CAST(sum(x * x) AS BIGINT) AS xx, CAST(sum(y * y) AS BIGINT) AS yy, CAST(sum(x * y) AS BIGINT) AS xy FROM {cells} GROUP BY mask_id)""")
    fragment(f"{name}_turn", f"SELECT mask_id, cx, cy, cos(t) AS c, sin(t) AS s FROM (SELECT mask_id, cx, cy, CASE WHEN t >= pi() / 2 THEN t - pi() ELSE t END AS t FROM {name}_sums)")
    corner = [(x, y) for x in ("(l - cx)", "(rr - cx)") for y in ("(t - cy)", "(b - cy)")]
    us, vs = ", ".join(f"{x} * c + {y} * s" for x, y in corner), ", ".join(f"{y} * c - {x} * s" for x, y in corner)
    fragment(f"{name}_frame", f"""
SELECT mask_id, cx, cy, c, s, CAST(floor(least({us})) AS BIGINT) - 1 AS u0, CAST(ceil(greatest({us})) AS BIGINT) + 1 AS u1, CAST(floor(least({vs})) AS BIGINT) - 1 AS v0, CAST(ceil(greatest({vs})) AS BIGINT) + 1 AS v1
FROM {name}_turn JOIN {box} USING (mask_id)""")
    fragment(f"{name}_hits", f"""
SELECT g.mask_id, u, v FROM (
  SELECT mask_id, u, v, floor(cx + u * c - v * s + 0.5) AS sx, floor(cy + u * s + v * c + 0.5) AS sy FROM (SELECT *, unnest(range(u0, u1 + 1)) AS u FROM (SELECT *, unnest(range(v0, v1 + 1)) AS v FROM {name}_frame))) g
JOIN {cells} k ON k.mask_id = g.mask_id AND k.x = g.sx AND k.y = g.sy""")
    fragment(f"{name}_crop", f"""
SELECT *, CAST(greatest(round_even(h * f, 0), 1) AS BIGINT) AS hh, CAST(greatest(round_even(w * f, 0), 1) AS BIGINT) AS ww FROM (
  SELECT *, least(CAST({side} AS DOUBLE) / w, CAST({side} AS DOUBLE) / h) AS f FROM (SELECT mask_id, min(u) AS u0, min(v) AS v0, max(v) - min(v) + 1 AS h, max(u) - min(u) + 1 AS w FROM {name}_hits GROUP BY mask_id))""")
    fragment(f"{name}_cells", f"""
SELECT d.mask_id, {side} AS side, d.y + ({side} - hh) // 2 AS y, d.x + ({side} - ww) // 2 AS x FROM (
  SELECT *, v0 + (2 * y + 1) * h // (2 * hh) AS v, u0 + (2 * x + 1) * w // (2 * ww) AS u FROM (SELECT *, unnest(range(0, ww)) AS x FROM (SELECT *, unnest(range(0, hh)) AS y FROM {name}_crop))) d
JOIN {name}_hits k ON k.mask_id = d.mask_id AND k.u = d.u AND k.v = d.v""")
    fragment(f"{name}_runs", f"""
SELECT mask_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY mask_id, y ORDER BY x) AS g FROM {name}_cells) GROUP BY mask_id, y, g""")


canonical_fragments("c32", "v_cells", "v_box", 32)
canonical_fragments("c64", "v_cells", "v_box", aligned.SIDE)


@query("mask_canonical_pose", q("SELECT mask_id, y, x0, x1 FROM c32_runs"))
def mask_canonical_pose(spark, sf):
    return forms.long_runs(aligned.bits_to_runs(aligned.canonical_bits(forms.shapes(spark, sf), 32), 32))


fragment("g_edge", """
SELECT mask_id, y, x FROM g_cells c WHERE (SELECT count(*) FROM g_cells n WHERE n.mask_id = c.mask_id AND abs(n.y - c.y) + abs(n.x - c.x) = 1) < 4""")


@query("mask_edge_channel", q("SELECT mask_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY mask_id, y ORDER BY x) AS g FROM g_edge) GROUP BY mask_id, y, g"))
def mask_edge_channel(spark, sf):
    return forms.long_runs(pose.edge_runs(grid_runs(spark, sf)))


fragment("g_dist", "SELECT c.mask_id, c.y, c.x, min(sqrt(pow(b.y - c.y, 2) + pow(b.x - c.x, 2))) AS d FROM g_cells c JOIN g_back b USING (mask_id) GROUP BY ALL")


@query("mask_distance_channel", q("SELECT mask_id, y, x, " + sql_r6("d / max(d) OVER (PARTITION BY mask_id)", "distance") + " FROM g_dist"))
def mask_distance_channel(spark, sf):
    rows = pose.distance_channel(grid_runs(spark, sf))
    return rows.select("mask_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), r6(F.col("distance")).alias("distance"))
