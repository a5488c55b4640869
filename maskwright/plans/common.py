"""Tables that many queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import predict, split
from maskwright.session import materialize
from maskwright.sources import tables

LINE_FEATURES = ["words", "lines", "digits"]


def samples_split(spark: SparkSession, sf: str, features: tuple[str, ...] = ()) -> DataFrame:
    """Samples with their split; with text features it is stored once, as the feature index is.

    Deriving features from whole texts is the expensive part, so no later step repeats it.
    """
    rows = tables.samples(spark, sf, features)
    if not features:
        return split.stratified_split(rows)
    stored, n = materialize(rows.withColumn("_row", F.lit(True)), "_row")
    return split.stratified_split(stored, n=n)


def text_features(spark: SparkSession, sf: str, features: tuple[str, ...]) -> DataFrame:
    """The samples with text features, stored once."""
    return materialize(tables.samples(spark, sf, features))[0]


def orders_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified_split(tables.samples_large(spark, sf))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return predict.oof_predictions(samples_split(spark, sf, tuple(LINE_FEATURES)), LINE_FEATURES)


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).where("role = 'candidate'")


def masks_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified_split(tables.mask_targets(spark, sf)).withColumnRenamed("sample_id", "mask_id")
