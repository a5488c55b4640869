"""Redundancy between features: correlation of every pair and the structural relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.ranks import pairwise_pearson, rank_columns, strength

# Removal groups, redundancy families and structural relations, in definition order.
REMOVAL_GROUPS = {
    "area_transformations": ("equivalent_diameter", "area_power_1_5", "area_major_axis_product"),
    "bounding_rectangle_relations": ("bbox_area", "aspect_ratio", "extent"),
    "equivalent_ellipse_relation": ("roundness",),
    "vertical_occupancy_relation": ("center_to_end_occupancy_ratio",),
    "convex_hull_relations": ("solidity", "convexity"),
    "area_contour_relation": ("circularity",),
}
FAMILIES = {
    "area_transformations": ("area", "equivalent_diameter", "area_power_1_5", "area_major_axis_product", "major_axis_length"),
    "bounding_rectangle_relations": ("area", "bbox_width", "bbox_height", "bbox_area", "aspect_ratio", "extent"),
    "equivalent_ellipse_relation": ("area", "major_axis_length", "minor_axis_length", "roundness"),
    "vertical_occupancy_relation": (
        "center_vertical_occupancy", "end_vertical_occupancy_min", "end_vertical_occupancy_max", "center_to_end_occupancy_ratio",
    ),
    "convex_hull_relations": ("area", "perimeter", "convex_area", "solidity", "convexity"),
    "area_contour_relation": ("area", "perimeter", "circularity"),
}
RELATIONS = {
    "area_bijection": ("area", "equivalent_diameter", "area_power_1_5"),
    "area_major_axis_product": ("area", "major_axis_length", "area_major_axis_product"),
    "bbox_area_product": ("bbox_width", "bbox_height", "bbox_area"),
    "bbox_aspect_ratio": ("bbox_width", "bbox_height", "aspect_ratio"),
    "bbox_extent": ("area", "bbox_area", "extent"),
    "ellipse_roundness": ("area", "major_axis_length", "roundness"),
    "vertical_occupancy_ratio": (
        "center_vertical_occupancy", "end_vertical_occupancy_min", "end_vertical_occupancy_max", "center_to_end_occupancy_ratio",
    ),
    "convex_solidity": ("area", "convex_area", "solidity"),
    "convexity_ratio": ("perimeter", "convexity"),
    "area_contour_circularity": ("area", "perimeter", "circularity"),
}


def membership(spark: SparkSession, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """(name, ordinal, feature) of a set of named feature groups."""
    rows = [(name, i, feature) for i, (name, members) in enumerate(groups.items()) for feature in members]
    return spark.createDataFrame(rows, "name string, ordinal int, feature string")


def label_pairs(pairs: DataFrame, relations: dict[str, tuple[str, ...]] | None = None, families: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Add every structural relation that holds both features, and the first family that does."""
    spark = pairs.sparkSession

    def shared(groups: dict[str, tuple[str, ...]]) -> DataFrame:
        m = membership(spark, groups)
        a = m.select("name", "ordinal", F.col("feature").alias("feature_a"))
        b = m.select("name", F.col("feature").alias("feature_b"))
        return a.join(F.broadcast(b), "name")

    related = shared(relations or RELATIONS).groupBy("feature_a", "feature_b").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda s: s["name"]), "|").alias("structural_relation")
    )
    family = shared(families or FAMILIES).groupBy("feature_a", "feature_b").agg(F.min_by("name", "ordinal").alias("removal_group"))
    return (
        pairs.join(F.broadcast(related), ["feature_a", "feature_b"], "left")
        .join(F.broadcast(family), ["feature_a", "feature_b"], "left")
        .fillna("none", ["structural_relation", "removal_group"])
    )


def correlations(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Pearson and Spearman of every ordered feature pair."""
    straight = pairwise_pearson(df, features)
    ranked = pairwise_pearson(rank_columns(df, key, features), features, "spearman")
    names = F.array(*[F.lit(f) for f in features])
    return straight.join(F.broadcast(ranked), ["i", "j"]).select(
        F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"), "pearson", "spearman"
    )


def redundancy(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    return label_pairs(correlations(df, key, features))


def strongest(pairs: DataFrame, top: int = 20) -> DataFrame:
    """The `top` pairs by the larger absolute correlation."""
    return pairs.withColumn("strength", strength(F.col("pearson"), F.col("spearman"))).orderBy(
        F.desc("strength"), "feature_a", "feature_b"
    ).limit(top)


def matrix(pairs: DataFrame, features: list[str], value: str = "pearson") -> DataFrame:
    """Symmetric matrix with a unit diagonal, one row per feature."""
    mirrored = pairs.select("feature_a", "feature_b", value).unionByName(
        pairs.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), value)
    )
    diagonal = pairs.select(F.explode(F.array("feature_a", "feature_b")).alias("feature_a")).distinct().select(
        "feature_a", F.col("feature_a").alias("feature_b"), F.lit(1.0).alias(value)
    )
    return mirrored.unionByName(diagonal).groupBy(F.col("feature_a").alias("feature")).pivot("feature_b", features).agg(F.first(value))
