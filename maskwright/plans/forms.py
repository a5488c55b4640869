"""Queries: components, quality, morphology and perturbations of masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskwright.functions import r6
from maskwright.operators import checks, components, diagnostics, geometry, morphology, predict, runs
from maskwright.plans.common import masks_split
from maskwright.plans.oracle import fragment, q, r6 as sql_r6
from maskwright.plans.registry import query
from maskwright.plans.shapes import FEATURE_SQL, cell_measures, grid_runs
from maskwright.sources import tables


def long_runs(df, *extra):
    return df.select("mask_id", *extra, *[F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")])


def shapes(spark, sf):
    return tables.silhouette_runs(spark, sf)


def shape_dims(spark, sf):
    """Frame of every silhouette, from the ids alone."""
    side = (F.lit(tables.GRID_SIDE * tables.BLOCK + tables.FAR_MARGIN + 1) + F.pmod("mask_id", F.lit(4))).cast("int")
    return tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("mask_id"), side.alias("h"), side.alias("w"))


def grid_dims(spark, sf):
    return tables.grid_bits(spark, sf).select("mask_id", "h", "w")


def component_fragments(name: str, cells_runs: str) -> None:
    """Reachability over touching runs; the label of a run is the smallest run it reaches."""
    fragment(f"{name}_nodes", f"SELECT mask_id, y, x0, x1, y * 2097152 + x0 AS node FROM {cells_runs}")
    fragment(f"{name}_edges", f"""
SELECT a.mask_id, a.node AS u, b.node AS v FROM {name}_nodes a JOIN {name}_nodes b ON a.mask_id = b.mask_id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1""")
    fragment(f"{name}_reach", f"""/*RECURSIVE*/
SELECT mask_id, node, node AS label FROM {name}_nodes UNION SELECT e.mask_id, e.v, r.label FROM {name}_reach r JOIN {name}_edges e ON e.mask_id = r.mask_id AND e.u = r.node""")
    fragment(f"{name}_lab", f"SELECT n.mask_id, n.y, n.x0, n.x1, r.component FROM {name}_nodes n JOIN (SELECT mask_id, node, min(label) AS component FROM {name}_reach GROUP BY ALL) r USING (mask_id, node)")
    fragment(f"{name}_sizes", f"SELECT mask_id, component, sum(x1 - x0 + 1) AS size FROM {name}_lab GROUP BY ALL")


component_fragments("gc", "g_runs")


@query("component_labels", q("SELECT mask_id, y, x0, x1, component FROM gc_lab"))
def component_labels(spark, sf):
    # blocks of two rows, so that labels also travel between blocks
    return long_runs(components.label_components(grid_runs(spark, sf), row_block=2), "component")


@query("component_counts", q("SELECT mask_id, count(*) AS components, " + sql_r6("max(size) / sum(size)", "largest_fraction") + " FROM gc_sizes GROUP BY mask_id"))
def component_counts(spark, sf):
    rows = components.component_counts(components.label_components(grid_runs(spark, sf)))
    return rows.select("mask_id", "components", r6(F.col("largest_fraction")).alias("largest_fraction"))


fragment("g_all64", "SELECT vec_id AS mask_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, embedding[i] > 0 AS lit FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)")
fragment("g_back", "SELECT mask_id, y, x FROM g_all64 WHERE NOT lit")
fragment("g_flood", """/*RECURSIVE*/
SELECT mask_id, y, x FROM g_back WHERE y IN (0, 7) OR x IN (0, 7)
UNION SELECT b.mask_id, b.y, b.x FROM g_flood f JOIN g_back b ON b.mask_id = f.mask_id AND abs(b.y - f.y) + abs(b.x - f.x) = 1""")
fragment("g_holes", "SELECT mask_id, count(*) AS holes FROM (SELECT * FROM g_back EXCEPT SELECT * FROM g_flood) GROUP BY mask_id")


@query("hole_ratio", q("SELECT mask_id, holes, " + sql_r6("holes / a", "hole_ratio") + " FROM g_holes JOIN g_box USING (mask_id)"))
def hole_ratio(spark, sf):
    masks = grid_runs(spark, sf)
    holes = components.hole_cells(masks, grid_dims(spark, sf))
    areas = morphology.touches_border(masks).select("mask_id", "area")
    return holes.join(areas, "mask_id").select("mask_id", "holes", r6(F.col("holes") / F.col("area")).alias("hole_ratio"))


@query("mask_quality", q("SELECT mask_id, 8 AS w, 8 AS h, " + sql_r6("a / 64", "foreground_ratio") + ", component_count, largest_fraction, " + sql_r6("coalesce(holes, 0) / a", "hole_ratio") + """,
  CAST(l = 0 OR rr = 7 OR t = 0 OR b = 7 AS BIGINT) AS touches_border FROM g_box
JOIN (SELECT mask_id, count(*) AS component_count, """ + sql_r6("max(size) / sum(size)", "largest_fraction") + " FROM gc_sizes GROUP BY mask_id) USING (mask_id) LEFT JOIN g_holes USING (mask_id)"))
def mask_quality(spark, sf):
    rows = morphology.quality(grid_runs(spark, sf), grid_dims(spark, sf))
    return rows.select(
        "mask_id", "w", "h", r6(F.col("foreground_ratio")).alias("foreground_ratio"), "component_count", r6(F.col("largest_fraction")).alias("largest_fraction"),
        r6(F.col("hole_ratio")).alias("hole_ratio"), F.col("touches_border").cast("long").alias("touches_border"),
    )


@query("mask_digests", q("""
SELECT mask_id, sha256('8x8x' || string_agg(line, ';' ORDER BY y)) AS digest FROM (
  SELECT mask_id, y, y || ':' || string_agg(x0 || '-' || x1, ',' ORDER BY x0) AS line FROM g_runs GROUP BY mask_id, y) GROUP BY mask_id"""))
def mask_digests(spark, sf):
    return runs.digests(grid_runs(spark, sf)).select("mask_id", "digest")


@query("duplicate_masks", q("""
SELECT digest, count(*) AS n, min(mask_id) AS first_id FROM (
  SELECT mask_id, sha256('8x8x' || string_agg(line, ';' ORDER BY y)) AS digest FROM (
    SELECT mask_id, y, y || ':' || string_agg(x0 || '-' || x1, ',' ORDER BY x0) AS line FROM g_runs GROUP BY mask_id, y) GROUP BY mask_id)
GROUP BY digest HAVING count(*) > 1"""))
def duplicate_masks(spark, sf):
    return checks.duplicate_content(runs.digests(grid_runs(spark, sf)))


@query("disk_elements", q("""
SELECT vec_id AS mask_id, r, dy, max(dx) AS half FROM (
  SELECT vec_id, r, dy, unnest(range(0, r + 1)) AS dx FROM (
    SELECT vec_id, r, unnest(range(-r, r + 1)) AS dy FROM (SELECT vec_id, CAST(greatest(floor(5 * (41 + vec_id % 4) / CAST(32 AS DOUBLE) + 0.5), 1) AS BIGINT) AS r FROM embeddings)))
WHERE dx * dx + dy * dy <= r * r GROUP BY ALL"""))
def disk_elements(spark, sf):
    radius = morphology.disk_radius(5, 32)
    rows = shape_dims(spark, sf).withColumn("r", radius).select("mask_id", "r", F.inline(morphology.disk_rows(F.col("r"))))
    return rows.select("mask_id", *[F.col(c).cast("long").alias(c) for c in ("r", "dy", "half")])


fragment("disk2", "SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE dx * dx + dy * dy <= 4")
fragment("disk1", "SELECT dy, dx FROM disk2 WHERE dx * dx + dy * dy <= 1")
fragment("diamond2", "SELECT dy, dx FROM disk2 WHERE abs(dx) + abs(dy) <= 2")


def morph_fragments(cells: str, disk: str, name: str) -> None:
    """Dilation and erosion cell by cell."""
    fragment(f"{name}_dil", f"SELECT DISTINCT mask_id, side, y + dy AS y, x + dx AS x FROM {cells}, {disk} WHERE y + dy >= 0 AND y + dy < side AND x + dx >= 0 AND x + dx < side")
    fragment(f"{name}_probe", f"SELECT mask_id, side, y, x, y + dy AS ny, x + dx AS nx FROM {cells}, {disk}")
    fragment(f"{name}_ero", f"""
SELECT c.mask_id, c.side, c.y, c.x FROM {name}_probe c JOIN {cells} n ON n.mask_id = c.mask_id AND n.y = c.ny AND n.x = c.nx
GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM {disk})""")
    for kind in ("dil", "ero"):
        fragment(f"{name}_{kind}_runs", f"""
SELECT mask_id, side, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY mask_id, y ORDER BY x) AS g FROM {name}_{kind}) GROUP BY mask_id, side, y, g""")


morph_fragments("v_cells", "disk2", "v2")
morph_fragments("v_cells", "disk1", "v1")
morph_fragments("v_cells", "diamond2", "vd")


@query("mask_expansion", q("SELECT mask_id, y, x0, x1 FROM v2_dil_runs"))
def mask_expansion(spark, sf):
    return long_runs(morphology.expand(shapes(spark, sf), morphology.disk_rows(morphology.disk_radius(5, 128))))


@query("mask_contraction", q("SELECT mask_id, y, x0, x1 FROM v2_ero_runs"))
def mask_contraction(spark, sf):
    return long_runs(morphology.contract(shapes(spark, sf), morphology.disk_rows(morphology.disk_radius(5, 128))))


fragment("v_centre", "SELECT mask_id, side, avg(x) AS cx, avg(y) AS cy FROM v_cells GROUP BY mask_id, side")
for _name, _s in (("shrink", 0.95), ("grow", 1.05)):
    fragment(f"v_{_name}", f"""
SELECT d.mask_id, d.side, d.y, d.x FROM (
  SELECT mask_id, side, y, x, round_even(cy + (y - cy) / CAST({_s} AS DOUBLE), 0) AS sy, round_even(cx + (x - cx) / CAST({_s} AS DOUBLE), 0) AS sx FROM (
    SELECT *, unnest(range(0, side)) AS x FROM (SELECT *, unnest(range(0, side)) AS y FROM v_centre))) d
JOIN v_cells c ON c.mask_id = d.mask_id AND c.y = d.sy AND c.x = d.sx""")
    fragment(f"v_{_name}_runs", f"""
SELECT mask_id, side, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY mask_id, y ORDER BY x) AS g FROM v_{_name}) GROUP BY mask_id, side, y, g""")


@query("mask_scale_shrink", q("SELECT mask_id, y, x0, x1 FROM v_shrink_runs"))
def mask_scale_shrink(spark, sf):
    return long_runs(morphology.rescale(shapes(spark, sf), 0.95))


@query("mask_scale_grow", q("SELECT mask_id, y, x0, x1 FROM v_grow_runs"))
def mask_scale_grow(spark, sf):
    return long_runs(morphology.rescale(shapes(spark, sf), 1.05))


fragment("v_shift_d", "SELECT mask_id, side, CAST(greatest(floor(side * CAST(0.05 AS DOUBLE) + 0.5), 1) AS BIGINT) AS d FROM (SELECT DISTINCT mask_id, side FROM v_cells)")
fragment("v_directions", "SELECT unnest(['shift_up', 'shift_down', 'shift_left', 'shift_right']) AS perturbation, unnest([-1, 1, 0, 0]) AS sy, unnest([0, 0, -1, 1]) AS sx")
fragment("v_cuts", """
SELECT mask_id, perturbation, d AS distance, bool_or(y + sy * d < 0 OR y + sy * d >= c.side OR x + sx * d < 0 OR x + sx * d >= c.side) AS cuts
FROM v_cells c JOIN v_shift_d USING (mask_id), v_directions GROUP BY ALL""")


@query("shift_cuts", q("SELECT * FROM v_cuts"))
def shift_cuts(spark, sf):
    rows = morphology.shift_cuts(shapes(spark, sf))
    return rows.select("mask_id", "perturbation", F.col("distance").cast("long").alias("distance"), "cuts")


@query("mask_shift", q("""
SELECT mask_id, y - d AS y, x0, x1, y0 < d AS cuts FROM v_runs JOIN v_shift_d USING (mask_id) JOIN (SELECT mask_id, min(y) AS y0 FROM v_runs GROUP BY 1) USING (mask_id) WHERE y - d >= 0"""))
def mask_shift(spark, sf):
    return long_runs(morphology.shift(shapes(spark, sf), -morphology.shift_distance(), F.lit(0)), "cuts")


component_fragments("vo", "v_runs")
component_fragments("ve", "v1_dil_runs")
component_fragments("vc", "v1_ero_runs")


def topo_fragment(name: str, other: str) -> None:
    fragment(name, f"""
SELECT o.mask_id, n_original, coalesce(n_perturbed, 0) AS n_perturbed, coalesce(pairs, 0) AS pairs, n_original = coalesce(n_perturbed, 0) AND n_original = coalesce(pairs, 0) AND n_original = coalesce(sources, 0) AND n_original = coalesce(targets, 0) AS valid
FROM (SELECT mask_id, count(DISTINCT component) AS n_original FROM vo_lab GROUP BY 1) o
LEFT JOIN (SELECT mask_id, count(DISTINCT component) AS n_perturbed FROM {other}_lab GROUP BY 1) p USING (mask_id)
LEFT JOIN (SELECT mask_id, count(*) AS pairs, count(DISTINCT s) AS sources, count(DISTINCT t) AS targets FROM (
  SELECT DISTINCT a.mask_id, a.component AS s, b.component AS t FROM vo_lab a JOIN {other}_lab b ON a.mask_id = b.mask_id AND a.y = b.y AND a.x0 <= b.x1 AND b.x0 <= a.x1) GROUP BY 1) m USING (mask_id)""")


topo_fragment("topo_e", "ve")
topo_fragment("topo_c", "vc")


@query("mask_topology", q("""
SELECT mask_id, 'expansion' AS variant, n_original, n_perturbed, pairs, valid FROM topo_e UNION ALL SELECT mask_id, 'contraction', n_original, n_perturbed, pairs, valid FROM topo_c WHERE n_perturbed > 0"""))
def mask_topology(spark, sf):
    labelled = components.label_components(morphology.morphology_variants(runs.by_mask(shapes(spark, sf))[0]), ["mask_id", "variant"])
    return components.topology(labelled, "original").where("variant IS NOT NULL").select("mask_id", "variant", "n_original", "n_perturbed", "pairs", "valid")


fragment("v_elig", """
SELECT mask_id, CASE WHEN edge THEN 'insufficient_expansion_margin' WHEN NOT ev THEN 'expansion_topology_violation' WHEN NOT cv THEN 'contraction_topology_violation' ELSE '' END AS reason FROM (
  SELECT o.mask_id, edge, o.valid AS ev, c.valid AS cv FROM topo_e o JOIN topo_c c USING (mask_id)
  JOIN (SELECT mask_id, bool_or(y = 0 OR x = 0 OR y = side - 1 OR x = side - 1) AS edge FROM v1_dil GROUP BY 1) USING (mask_id))""")


@query("morphology_eligibility", q("SELECT mask_id, CASE WHEN reason = '' THEN 'eligible' ELSE 'rejected' END AS status, reason FROM v_elig"))
def morphology_eligibility(spark, sf):
    return morphology.eligibility(shapes(spark, sf), shape_dims(spark, sf))


@query("rejection_counts", q("SELECT CASE WHEN reason = '' THEN 'eligible' ELSE 'rejected' END AS status, reason, count(*) AS n FROM v_elig GROUP BY ALL"))
def rejection_counts(spark, sf):
    return diagnostics.rejection_counts(morphology.eligibility(shapes(spark, sf), shape_dims(spark, sf)))


@query("mask_scenarios", q("""
SELECT mask_id, scenario, count(*) AS area, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM (
  SELECT mask_id, 'original' AS scenario, y, x FROM v_cells
  UNION ALL SELECT mask_id, 'erosion_1', y, x FROM v1_ero UNION ALL SELECT mask_id, 'erosion_2', y, x FROM vd_ero
  UNION ALL SELECT mask_id, 'dilation_1', y, x FROM v1_dil UNION ALL SELECT mask_id, 'dilation_2', y, x FROM vd_dil
  UNION ALL SELECT mask_id, 'shift_4', y, x + 4 FROM v_cells WHERE x + 4 < side) GROUP BY ALL"""))
def mask_scenarios(spark, sf):
    n = (F.col("x1") - F.col("x0") + 1).cast("long")
    return morphology.scenarios(shapes(spark, sf)).groupBy("mask_id", "scenario").agg(
        F.sum(n).alias("area"), F.sum(F.expr("(x0 + x1) * (x1 - x0 + 1) div 2")).alias("sx"), F.sum(n * F.col("y")).alias("sy")
    )


@query("mask_augmentation", q("""
SELECT mask_id, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area, min(x0) >= 0 AND max(x1) < max(side) AND min(y) >= 0 AND max(y) < max(side) AS inside FROM v_runs GROUP BY mask_id"""))
def mask_augmentation(spark, sf):
    moved = morphology.augment(shapes(spark, sf), 44, 1)
    return moved.groupBy("mask_id").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"),
        ((F.min("x0") >= 0) & (F.max("x1") < F.max("w")) & (F.min("y") >= 0) & (F.max("y") < F.max("h"))).alias("inside"),
    )


# --- sensitivity of a linear model on all measurements ----------------------------------------
fragment("m_base", "SELECT e.vec_id AS mask_id, s.grp, s.target FROM embeddings e JOIN s_base s ON s.sample_id = e.vec_id % (SELECT count(*) FROM documents)")
fragment("m_split", """
SELECT *, 'B' || cno AS category, (row_number() OVER (ORDER BY cno, sha256('42:' || mask_id), mask_id) - 1) % 5 + 1 AS fold
FROM (SELECT *, LEAST((row_number() OVER (ORDER BY target, mask_id) - 1) * 10 // count(*) OVER () + 1, 10) AS cno FROM m_base)""")
fragment("m_area", "SELECT s.*, a * pow(1024.0 / (41 + s.mask_id % 4), 2) AS area FROM m_split s JOIN v_box USING (mask_id)")
fragment("m_lines", "SELECT f.outer_fold AS fold, regr_slope(target, area) AS slope, regr_intercept(target, area) AS icpt FROM m_area m JOIN folds5 f ON m.fold <> f.outer_fold GROUP BY f.outer_fold")
SHRINK = 0.1
NAMES = list(geometry.FEATURES)
fragment("m_kinds", "SELECT unnest(['scale_shrink', 'scale_grow', 'shift_up', 'shift_down', 'shift_left', 'shift_right', 'contraction', 'expansion']) AS perturbation, unnest(range(0, 8)) AS k")
fragment("p_cells", """
SELECT k * 1000000000 + mask_id AS mask_id, y, x FROM m_kinds JOIN (
  SELECT mask_id, 'scale_shrink' AS perturbation, y, x FROM v_shrink UNION ALL SELECT mask_id, 'scale_grow', y, x FROM v_grow
  UNION ALL SELECT mask_id, 'expansion', y, x FROM v1_dil UNION ALL SELECT mask_id, 'contraction', y, x FROM v1_ero
  UNION ALL SELECT c.mask_id, perturbation, y, x FROM v_cuts c JOIN v_cells USING (mask_id) WHERE NOT cuts) USING (perturbation)""")
cell_measures("p_cells", "p")


def _long_features(name: str, source: str) -> None:
    """(mask_id, i, v): the scaled measurements of a table of measured masks, one row each."""
    safe = {**FEATURE_SQL, "roundness": "4 * area / nullif(pi() * major * major, 0)"}
    rows = ", ".join(f"{{'i': {i}, 'v': CAST(({safe[f]}) * pow(1024.0 / (41 + mask_id % 1000000000 % 4), {geometry.DIMENSION.get(f, 0)}) AS DOUBLE)}}" for i, f in enumerate(NAMES, 1))
    fragment(name, f"SELECT mask_id, u.i, u.v FROM (SELECT mask_id, unnest([{rows}]) AS u FROM {source})")


_long_features("mf_long", "v_all")
_long_features("pf_long", "p_all")
P = len(NAMES)
fragment("mf_train", "SELECT f.outer_fold AS fold, l.mask_id, l.i, l.v, m.target FROM mf_long l JOIN m_split m USING (mask_id) JOIN folds5 f ON m.fold <> f.outer_fold")
fragment("mf_mean", "SELECT fold, i, avg(v) AS mv, avg(target) AS mt, covar_pop(v, target) AS cy FROM mf_train GROUP BY fold, i")
fragment("mf_cov", f"""
SELECT a.fold, a.i, b.i AS j, covar_pop(a.v, b.v) * CASE WHEN a.i = b.i THEN {1 + SHRINK} ELSE 1 END AS c FROM mf_train a JOIN mf_train b ON a.fold = b.fold AND a.mask_id = b.mask_id GROUP BY a.fold, a.i, b.i""")
# rows of the system in units of the deviations, with the right side as the last entry; then Gauss and Jordan
fragment("mf_unit", "SELECT fold, i, sqrt(c) AS s FROM mf_cov WHERE i = j")
fragment("mf_system", """
SELECT fold, list(r ORDER BY i) AS m FROM (
  SELECT c.fold, c.i, list_append(list(c.c / (si.s * sj.s) ORDER BY c.j), any_value(y.cy / si.s)) AS r
  FROM mf_cov c JOIN mf_unit si ON si.fold = c.fold AND si.i = c.i JOIN mf_unit sj ON sj.fold = c.fold AND sj.i = c.j JOIN mf_mean y ON y.fold = c.fold AND y.i = c.i GROUP BY c.fold, c.i)
GROUP BY fold""")
fragment("mf_solving", f"""/*RECURSIVE*/
SELECT fold, 1 AS k, m FROM mf_system UNION ALL
SELECT fold, k + 1, list_transform(range(1, {P + 1}), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k])
  ELSE list_transform(range(1, {P + 2}), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END) FROM mf_solving WHERE k <= {P}""")
fragment("mf_weights", f"SELECT w.fold, u.i, w.m[u.i][{P + 1}] / u.s AS b FROM mf_solving w JOIN mf_unit u ON u.fold = w.fold WHERE w.k = {P + 1}")
fragment("mf_icpt", "SELECT w.fold, any_value(mt) - sum(b * mv) AS b0 FROM mf_weights w JOIN mf_mean m ON m.fold = w.fold AND m.i = w.i GROUP BY w.fold")
fragment("mf_original", "SELECT l.mask_id, m.fold, any_value(b0) + sum(b * v) AS original FROM mf_long l JOIN m_split m USING (mask_id) JOIN mf_weights w ON w.fold = m.fold AND w.i = l.i JOIN mf_icpt c ON c.fold = m.fold GROUP BY l.mask_id, m.fold")
fragment("pf_after", """
SELECT l.mask_id, CASE WHEN count(v) = count(*) THEN any_value(b0) + sum(b * v) END AS perturbed
FROM pf_long l JOIN m_split m ON m.mask_id = l.mask_id % 1000000000 JOIN mf_weights w ON w.fold = m.fold AND w.i = l.i JOIN mf_icpt c ON c.fold = m.fold GROUP BY l.mask_id""")
fragment("m_records", """
SELECT m.mask_id, m.perturbation, CASE WHEN reason <> '' THEN 'rejected' ELSE 'eligible' END AS status, reason, original,
  CASE WHEN reason = '' THEN CASE WHEN p.mask_id IS NULL THEN b0 ELSE p.perturbed END END AS perturbed
FROM (SELECT o.*, k.perturbation, k.k, CASE WHEN k.perturbation LIKE 'shift%' AND c.cuts THEN 'shift_cuts_foreground' WHEN k.perturbation IN ('contraction', 'expansion') THEN e.reason ELSE '' END AS reason
  FROM mf_original o CROSS JOIN m_kinds k JOIN v_elig e USING (mask_id) LEFT JOIN v_cuts c ON c.mask_id = o.mask_id AND c.perturbation = k.perturbation) m
JOIN mf_icpt i ON i.fold = m.fold LEFT JOIN pf_after p ON p.mask_id = m.k * 1000000000 + m.mask_id""")


def sensitivity_records(spark, sf):
    """Every mask and perturbation, re-measured in all 26 features and scored by the linear model on them."""
    from maskwright.operators.sensitivity import sensitivity

    return sensitivity(shapes(spark, sf), shape_dims(spark, sf), masks_split(spark, sf), NAMES, 1024, SHRINK)


@query("sensitivity_records", q("SELECT mask_id, perturbation, status, reason, " + ", ".join([sql_r6("original", "original", 2), sql_r6("perturbed", "perturbed", 2), sql_r6("perturbed - original", "delta", 2)]) + " FROM m_records"))
def sensitivity_records_query(spark, sf):
    rows = sensitivity_records(spark, sf)
    return rows.select("mask_id", "perturbation", "status", "reason", *[r6(F.col(c), 2).alias(c) for c in ("original", "perturbed", "delta")])


@query("sensitivity_summary", q("SELECT perturbation, status, count(*) AS n, " + sql_r6("avg(abs(perturbed - original))", "mean_abs_delta", 3) + ", " + sql_r6("avg(perturbed - original)", "mean_delta", 3) + " FROM m_records GROUP BY ALL"))
def sensitivity_summary(spark, sf):
    rows = diagnostics.sensitivity_summary(sensitivity_records(spark, sf))
    return rows.select("perturbation", "status", "n", *[r6(F.col(c), 3).alias(c) for c in ("mean_abs_delta", "mean_delta")])
