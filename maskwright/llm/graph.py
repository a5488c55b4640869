"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.session import materialize

MAX_ROUNDS = 40


def connected_components(links: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every end of `links` (a, b); the component is its smallest id.

    Every round points all larger neighbours of a vertex at the smallest one it knows, then all smaller
    ones; both are a grouped minimum and a join, so no group is gathered. Rounds are written to the shared
    folder. Rows with a null end and links of a document with itself are ignored; no links give no rows.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    edges, _ = materialize(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = (
            both.where("v > u").join(low, "u")
            .groupBy(F.col("v").alias("u"), F.col("m").alias("v")).agg(F.max(F.col("m") != F.col("u")).alias("moved"))
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.max("moved").alias("moved"))
        small = large.select("u", "v").join(least.select("u", "m"), "u").where("v != m").select(
            F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved")
        ).unionByName(least.select("u", F.col("m").alias("v"), "moved"))
        edges, moved = materialize(small.groupBy("u", "v").agg(F.max("moved").alias("moved")), "moved")
        if moved == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return _settled(edges)


def _settled(edges: DataFrame) -> DataFrame:
    """Members of the stars and their centres."""
    stars = edges.groupBy("u").agg(F.min("v").alias("component_id"))
    centres = stars.select(F.col("component_id").alias("u")).distinct().join(stars, "u", "left_anti")
    return stars.select(F.col("u").alias("doc_id"), "component_id").unionByName(
        centres.select(F.col("u").alias("doc_id"), F.col("u").alias("component_id"))
    )
