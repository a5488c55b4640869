"""Bindings of the logical inputs (samples, masks) to parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.session import spread

GRID_SIDE = 8
BLOCK = 4
FAR_MARGIN = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_char(text: Column, char: str) -> Column:
    """Occurrences of one character: a byte search, no regular expression and no split."""
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


SAMPLE_FEATURES = ("words", "lines", "digits", "commas", "capitals", "distinct_words")


def samples(spark: SparkSession, sf_dir: str, features: tuple[str, ...] = ()) -> DataFrame:
    """Documents as samples: target is the length, group the language, resolution the source."""
    text = F.col("text")
    known = {
        "words": count_char(text, " ") + 1,
        "lines": count_char(text, "\n") + 1,
        "digits": F.regexp_count(text, F.lit("[0-9]")).cast("long"),
        "commas": count_char(text, ","),
        "capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("long"),
        "distinct_words": F.size(F.array_distinct(F.split(text, " "))).cast("long"),
    }
    docs = table(spark, sf_dir, "documents")
    if features:
        # whole texts are read, so a scan in few pieces is spread first
        docs = spread(docs.select("doc_id", "lang", "source", "n_chars", "text"))
    return docs.select(
        F.col("doc_id").alias("sample_id"),
        F.col("lang").alias("grp"),
        F.col("source").alias("resolution"),
        F.col("n_chars").cast("double").alias("target"),
        *[known[name].cast("double").alias(name) for name in features],
    )


def samples_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples: a larger table with one tie in the target."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"),
        F.col("o_orderpriority").alias("grp"),
        F.col("o_orderstatus").alias("resolution"),
        F.col("o_totalprice").alias("target"),
    )


def grid_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8x8 masks: one row per mask, `bits` in raster order."""
    return spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select(
        F.col("vec_id").alias("mask_id"),
        F.lit(GRID_SIDE).alias("h"),
        F.lit(GRID_SIDE).alias("w"),
        F.transform("embedding", lambda v: v > 0).alias("bits"),
    )


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per foreground cell."""
    cells = grid_bits(spark, sf_dir).select("mask_id", "h", "w", F.posexplode("bits").alias("i", "on"))
    return cells.where("on").select(
        "mask_id", "h", "w", F.expr(f"i div {GRID_SIDE}").cast("int").alias("y"), F.expr(f"i % {GRID_SIDE}").alias("x")
    )


def silhouette_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger masks: every grid row filled from its first to its last bit, cells drawn as 4x4 blocks.

    The top and left margin is 1 to 4 pixels (by id), the others are 8, so that border rules have
    masks on both sides.
    """
    margin = (F.lit(1) + F.pmod(F.col("mask_id"), F.lit(4))).cast("int")
    rows = (
        grid_bits(spark, sf_dir)
        .withColumn("m", margin)
        .select("mask_id", "m", F.explode(F.sequence(F.lit(0), F.lit(GRID_SIDE - 1))).alias("r"), "bits")
        .withColumn("row", F.slice("bits", F.col("r") * GRID_SIDE + 1, GRID_SIDE))
        .withColumn("lo", F.array_position("row", F.lit(True)).cast("int") - 1)
        .withColumn("hi", F.lit(GRID_SIDE) - F.array_position(F.reverse("row"), F.lit(True)).cast("int"))
        .where(F.col("lo") >= 0)
    )
    side = (F.lit(GRID_SIDE * BLOCK + FAR_MARGIN) + F.col("m")).cast("int")
    return rows.select(
        "mask_id",
        side.alias("h"),
        side.alias("w"),
        F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1))).alias("k"),
        *["m", "r", "lo", "hi"],
    ).select(
        "mask_id",
        "h",
        "w",
        (F.col("m") + F.col("r") * BLOCK + F.col("k")).cast("int").alias("y"),
        (F.col("m") + F.col("lo") * BLOCK).cast("int").alias("x0"),
        (F.col("m") + F.col("hi") * BLOCK + BLOCK - 1).cast("int").alias("x1"),
    )


def mask_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and group of every mask: those of the document whose id is the mask's, counted round.

    A mask without such a document is an error, not a row less.
    """
    docs = samples(spark, sf_dir)
    n = max(docs.count(), 1)
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("mask_id"), F.pmod(F.col("vec_id"), F.lit(n)).alias("sample_id"))
    bound = ids.join(docs, "sample_id", "left").drop("sample_id").withColumnRenamed("mask_id", "sample_id")
    missing = F.raise_error(F.concat(F.lit("mask without a target: "), F.col("sample_id").cast("string"))).cast("double")
    return bound.withColumn("target", F.coalesce("target", missing)).select("sample_id", *[c for c in docs.columns if c != "sample_id"])
