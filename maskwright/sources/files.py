"""File sources and sinks: the curated index, mask images, deterministic text tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import fixed

INDEX_SCHEMA = T.StructType([
    T.StructField("file_name", T.StringType()), T.StructField("farm", T.StringType()), T.StructField("weight_kg", T.DoubleType()),
])
RUN_SCHEMA = T.StructType([
    T.StructField("mask_id", T.StringType()), T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()),
    T.StructField("y", T.IntegerType()), T.StructField("x0", T.IntegerType()), T.StructField("x1", T.IntegerType()),
    T.StructField("other_values", T.ArrayType(T.IntegerType())),
])
# Fixed value: image suffixes in order of preference.
SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp")


def require_columns(df: DataFrame, expected: list[str], name: str) -> DataFrame:
    if df.columns != expected:
        raise ValueError(f"columns of {name} were {df.columns!r}; expected {expected!r}")
    return df


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with an exact header: another header or a malformed value is an error."""
    header = spark.read.option("header", True).csv(path)
    require_columns(header, schema.fieldNames(), path)
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_table(spark, path, INDEX_SCHEMA)


def as_text(df: DataFrame, decimals: int = 6) -> DataFrame:
    """Floating columns as fixed-decimal text, NULL as the empty string."""
    types = dict(df.dtypes)
    return df.select(*[
        fixed(F.col(c), decimals).alias(c) if types[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        for c in df.columns
    ])


def write_csv_table(df: DataFrame, path: str, order: list[str], decimals: int = 6) -> None:
    """Deterministic CSV: rows in `order` (range-sorted files), numbers as fixed-decimal text."""
    as_text(df.orderBy(*order), decimals).write.mode("error").option("header", True).option("emptyValue", "").csv(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    """One JSON object per line with sorted keys."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("error").text(path)


def _image_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of decoded images; a mask without foreground gives one row with NULL ends."""
    for batch in batches:
        out = []
        for origin, h, w, channels, data in zip(batch["origin"], batch["height"], batch["width"], batch["nChannels"], batch["data"]):
            raster = np.frombuffer(data, dtype=np.uint8).reshape(h, w, channels)[:, :, 0]
            other = sorted(int(v) for v in np.setdiff1d(np.unique(raster), [0, 255]))
            padded = np.zeros((h, w + 2), dtype=np.int8)
            padded[:, 1:-1] = raster > 0
            step = np.diff(padded, axis=1)
            (y, x0), (_, x1) = np.nonzero(step == 1), np.nonzero(step == -1)
            name = origin.rsplit("/", 1)[-1]
            if len(y) == 0:
                out.append((name, h, w, None, None, None, other))
            out.extend((name, h, w, int(r), int(a), int(b) - 1, other) for r, a, b in zip(y, x0, x1))
        yield pd.DataFrame(out, columns=RUN_SCHEMA.fieldNames())


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """Image files to run tables; Spark decodes, only runs leave the task.

    `other_values` lists pixel values besides 0 and 255.
    """
    images = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(_image_runs, RUN_SCHEMA)


def mask_frames(runs: DataFrame) -> DataFrame:
    return runs.select("mask_id", "h", "w").distinct()


def resolve_stems(files: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """The preferred file of each stem: the first suffix in the given order wins."""
    order = F.array(*[F.lit(s) for s in suffixes])
    parts = files.select(
        "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).alias("suffix")
    )
    ranked = parts.withColumn("place", F.array_position(order, F.col("suffix"))).where("place > 0")
    return ranked.groupBy("stem").agg(F.min_by("name", F.struct("place", "name")).alias("name"), F.count("*").alias("n_files"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names, sizes and contents of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of the files below a folder as (file, size, at, line), in order inside each split of a file, which begins at `at`.

    Only line feeds end a line, and every line has one, so that a file's lines joined are its bytes; what Spark's reader does not
    tell is a line feed too many at the end of a file without one, and a byte order mark at its start, which is left out.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    line = F.concat(F.col("value").cast("binary"), F.lit(bytearray(b"\n")))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("at"), line.alias("line"))


def normalise_predictions(df: DataFrame, names: dict[str, str], configuration: str, approach: str, role: str) -> DataFrame:
    """One source's prediction table under the common column names (`names`: common -> source)."""
    return df.select(
        F.lit(configuration).alias("configuration"), F.lit(approach).alias("approach"), F.lit(role).alias("role"),
        *[F.col(source).alias(common) for common, source in names.items()],
    )


def feature_samples(features: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """Feature index joined to the split; ids on one side only are an error."""
    from maskwright.operators.checks import missing_and_extra

    odd = missing_and_extra(split, features, key)
    found = odd.groupBy("problem").agg(F.count("*").alias("n"), F.min(key).alias("first")).collect()
    if found:
        raise ValueError(f"feature and split ids differed: {[tuple(r) for r in found]!r}; expected identical id sets")
    return features.join(split, key)


def decorate(predictions: DataFrame, dimensions: DataFrame, key: str) -> DataFrame:
    """Candidates as baselines with group and resolution; reference rows are dropped."""
    kept = predictions.where(F.col("role").isin("candidate", "baseline")).withColumn(
        "role", F.when(F.col("role") == "candidate", "baseline").otherwise(F.col("role"))
    )
    return kept.join(dimensions, key)


