"""Sensitivity of linear predictions to perturbed masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators import morphology
from maskwright.operators.evidence import fold_models
from maskwright.operators.geometry import FEATURES, HULL_FEATURES, measure, scale
from maskwright.operators.runs import KEYS, by_mask
from maskwright.session import materialize

PERTURBATIONS = ("scale_shrink", "scale_grow", *morphology.SHIFTS, "contraction", "expansion")


def scaled_features(runs: DataFrame, keys: list[str], features: list[str], long_side: int) -> DataFrame:
    with_hull = any(f in HULL_FEATURES for f in features)
    return scale(measure(runs, keys, with_hull), long_side).select(*keys, *features)


def predicted(features: list[str]) -> Column:
    """Prediction of a row by the `weights` and `intercept` beside it; NULL where a feature is."""
    products = F.zip_with(F.array(*[F.col(f).cast("double") for f in features]), "weights", lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda a, v: a + v) + F.col("intercept")


def sensitivity(runs: DataFrame, dims: DataFrame, split: DataFrame, features: list[str], long_side: int = 1024, shrink: float = 0.0) -> DataFrame:
    """One record per mask and perturbation with the change of its held-out prediction.

    All perturbed masks are measured anew in one pass, in every one of `features`. A mask's prediction is that of the linear
    model on them (`shrink` as in the evidence) fitted without its fold; its weights, one row per fold, are broadcast.
    Rejected pairs keep their reason and a NULL change; a perturbation that erases a mask measures as zero.
    """
    unknown = [f for f in features if f not in FEATURES]
    if unknown:
        raise ValueError(f"features were {unknown!r}; expected names from the measurement contract")
    runs, _ = by_mask(runs.select(*KEYS, "y", "x0", "x1"))
    # the disk variants decide on eligibility and are measured as perturbations too
    variants, parts = by_mask(morphology.morphology_variants(runs, long_side))
    samples, _ = materialize(split.join(scaled_features(runs, KEYS, features, long_side), "mask_id"))
    model = F.broadcast(fold_models(samples, features, shrink))
    scored = samples.join(model, "fold").select("mask_id", "weights", "intercept", predicted(features).alias("original"))
    changed = scaled_features(morphology.perturbed(runs, variants), [*KEYS, "perturbation"], features, long_side).drop("h", "w").withColumn("measured", F.lit(True))
    cuts = morphology.shift_cuts(runs).select("mask_id", "perturbation", "cuts")
    verdict = morphology.eligibility_of(variants, parts, dims).select("mask_id", F.col("reason").alias("morphology_reason"))
    grid = scored.withColumn("perturbation", F.explode(F.array(*[F.lit(p) for p in PERTURBATIONS])))
    reason = (
        F.when(F.coalesce("cuts", F.lit(False)), "shift_cuts_foreground")
        .when(F.col("perturbation").isin("contraction", "expansion"), F.col("morphology_reason"))
        .otherwise("")
    )
    joined = (
        grid.join(cuts, ["mask_id", "perturbation"], "left").join(verdict, "mask_id")
        .join(changed, ["mask_id", "perturbation"], "left").withColumn("reason", reason)
    )
    eligible = F.col("reason") == ""
    after = F.when(eligible, F.when(F.col("measured"), predicted(features)).otherwise(F.col("intercept")))
    return joined.select(
        "mask_id", "perturbation", F.when(eligible, "eligible").otherwise("rejected").alias("status"), "reason", "original",
        after.alias("perturbed"), (after - F.col("original")).alias("delta"),
    )
