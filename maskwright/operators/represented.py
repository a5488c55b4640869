"""Masks as a model sees them: measurements beside components of two rasters, fitted inside each training set."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from maskwright.operators import grove, models
from maskwright.operators.neighbours import Components, fold_components, projected
from maskwright.session import materialize, spread

RAW_PARTS, CANONICAL_PARTS, SIDE = 24, 16, 96


@dataclass(frozen=True)
class Views:
    """Tables of the same masks: measurements (key, columns), stretched and aligned rasters (key, bits)."""

    measured: DataFrame
    raw: DataFrame
    canonical: DataFrame
    columns: tuple[str, ...]
    key: str = "mask_id"

    def of(self, ids: DataFrame) -> Views:
        keep = lambda d: d.join(ids.select(self.key), self.key, "left_semi")
        return Views(keep(self.measured), keep(self.raw), keep(self.canonical), self.columns, self.key)


@dataclass(frozen=True)
class Representation:
    """Components of both rasters of a training set; measurements and coordinates together are the features."""

    raw: Components
    canonical: Components

    @property
    def width(self) -> int:
        return self.raw.directions.shape[1] + self.canonical.directions.shape[1]

    def coordinates(self, views: Views) -> DataFrame:
        """(key, x) of every mask."""
        own = views.measured.select(views.key, F.array(*[F.col(c).cast("double") for c in views.columns]).alias("own"))
        joined = own.join(projected(views.raw, self.raw, views.key, "r"), views.key).join(projected(views.canonical, self.canonical, views.key, "c"), views.key)
        return joined.select(views.key, F.concat("own", "r", "c").alias("x"))

    def features(self, views: Views) -> DataFrame:
        return self.coordinates(views).select(views.key, array_to_vector("x").alias("features"))


def learn(views: Views, split: DataFrame, folds: list[int], raw_parts: int = RAW_PARTS, canonical_parts: int = CANONICAL_PARTS, side: int = SIDE) -> dict[int, Representation]:
    """The representation of every fold, learned from the masks outside it; all folds come out of the same passes."""

    def one(job) -> dict[int, Components]:
        bits, parts = job
        rows, _ = materialize(bits.join(split.select(views.key, F.col("fold").cast("int").alias("fold")), views.key).select("bits", "fold"))
        return fold_components(spread(rows), folds, parts, side * side)

    with ThreadPool(2) as pool:
        raw, canonical = pool.map(inheritable_thread_target(split.sparkSession)(one), [(views.raw, raw_parts), (views.canonical, canonical_parts)], chunksize=1)
    return {f: Representation(raw[f], canonical[f]) for f in folds}


def represented_predictions(train: Views, test: Views, split: DataFrame, recipe: dict, raw_parts: int = RAW_PARTS, canonical_parts: int = CANONICAL_PARTS, side: int = SIDE, owner=None) -> DataFrame:
    """(key, mask, fold, predicted) of every row of `test` by the forest that was fitted on `train` without the fold of its mask.

    `split` has the key, `fold` and `target` of every mask of `train`; `owner` makes the mask of a row of `test` of its key (itself by
    default). Components and a forest on the logarithm of the target are fitted for each fold, from its training masks alone; the
    folds are fitted side by side.
    """
    key = train.key
    owner = owner or (lambda c: c)
    folds, _ = materialize(split.select(key, "fold", F.log("target").alias("log_target")))
    owned = test.measured.select(key, owner(F.col(key)).alias("mask"))
    member = owned.join(folds.select(F.col(key).alias("mask"), "fold"), "mask")

    names = models.fold_list(folds)
    shapes = learn(train, folds, names, raw_parts, canonical_parts, side)

    def one(fold: int) -> DataFrame:
        shape = shapes[fold]
        outside = folds.where(F.col("fold") != fold)
        own = train.of(outside)
        ready, _ = materialize(shape.coordinates(own).join(outside, key))
        held = member.where(F.col("fold") == fold)
        asked = shape.coordinates(test.of(held))
        rows = ready.select("fold", F.col(key).alias("key"), F.col("log_target").alias("y"), "x")
        planted = grove.planted(rows, len(train.columns) + shape.width, {**models.FOREST, **recipe}, folds=[fold])
        if planted is None:
            model = models.forest(recipe, "log_target").fit(ready.withColumn("features", array_to_vector("x")))
            scored = model.transform(asked.withColumn("features", array_to_vector("x")))
        else:
            binned, _ = materialize(planted.vectors(asked.withColumn("fold", F.lit(fold))).drop("fold"))
            said = planted.said(binned.select("held", "vec", F.lit(True).alias("own")))
            scored = binned.join(said, ["held", "vec"]).withColumnRenamed("p0", "predicted")
        return materialize(scored.select(key, F.exp("predicted").alias("predicted")).join(held, key).select(key, "mask", "fold", "predicted"))[0]

    with ThreadPool(models.FITS_AT_ONCE) as pool:
        parts = pool.map(inheritable_thread_target(split.sparkSession)(one), names, chunksize=1)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
