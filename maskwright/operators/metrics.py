"""Regression metrics over long prediction tables."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.operators.ranks import group_percentiles

OBSERVED, PREDICTED = "observed", "predicted"


def _residual() -> Column:
    return F.col(PREDICTED) - F.col(OBSERVED)


def metric_columns(detailed: Column | None = None) -> list[Column]:
    """n, mae, rmse, bias and r2 as aggregates; r2 is NULL without variance or below two rows."""
    r = _residual()
    rmse = F.sqrt(F.avg(r * r))
    r2 = 1 - F.try_divide(F.sum(r * r), F.var_pop(OBSERVED) * F.count("*"))
    return [
        F.count("*").alias("n"),
        F.avg(F.abs(r)).alias("mae"),
        (rmse if detailed is None else F.when(detailed, rmse)).alias("rmse"),
        F.avg(r).alias("bias"),
        (r2 if detailed is None else F.when(detailed, r2)).alias("r2"),
    ]


def summarize(predictions: DataFrame, *by: str) -> DataFrame:
    return predictions.groupBy(*by).agg(*metric_columns())


def attach_percentiles(sums: DataFrame, rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Add exact percentiles of `value` to a table of group sums (one row per group, NULL groups included)."""
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    found = group_percentiles(rows, by, value, shares).select(group.alias("_g"), *shares)
    return sums.withColumn("_g", group).join(found, "_g", "left").drop("_g")


def summarize_extended(predictions: DataFrame, *by: str) -> DataFrame:
    """The metrics plus exact median and 90th percentile of the absolute error."""
    rows = predictions.withColumn("_e", F.abs(_residual()))
    return attach_percentiles(summarize(predictions, *by), rows, list(by), "_e", {"median_ae": 0.5, "p90_ae": 0.9})


def fold_and_pooled(predictions: DataFrame, last_category: str = "B10") -> DataFrame:
    """Fold rows and pooled rows (all, first and last category) per configuration in one pass.

    A row is expanded to the populations it belongs to, so pooled values come from predictions and
    never from fold means. rmse and r2 are given for the whole population only.
    """
    scopes = F.filter(
        F.array(
            F.struct(F.lit("fold").alias("scope"), F.col("fold").cast("long").alias("scope_fold"), F.lit("all").alias("population")),
            F.struct(F.lit("oof").alias("scope"), F.lit(None).cast("long").alias("scope_fold"), F.lit("all").alias("population")),
            F.struct(
                F.lit("oof").alias("scope"),
                F.lit(None).cast("long").alias("scope_fold"),
                F.when(F.col("category").isin("B1", last_category), F.col("category")).alias("population"),
            ),
        ),
        lambda s: s["population"].isNotNull(),
    )
    expanded = predictions.select("configuration", "approach", "role", OBSERVED, PREDICTED, F.inline(scopes))
    return (
        expanded.groupBy("configuration", "approach", "role", "scope", "scope_fold", "population")
        .agg(*metric_columns(F.col("population") == "all"))
        .withColumnRenamed("scope_fold", "fold")
    )


def population_metrics(predictions: DataFrame, last_category: str = "B10") -> DataFrame:
    """Metrics per fold and population, for all and for the two extreme categories."""
    populations = F.filter(
        F.array(F.lit("all"), F.when(F.col("category").isin("B1", last_category), F.col("category"))),
        lambda p: p.isNotNull(),
    )
    expanded = predictions.withColumn("population", F.explode(populations))
    return expanded.groupBy("configuration", "fold", "population").agg(*metric_columns())


def best_of_models(predictions: DataFrame) -> DataFrame:
    """Mean, median and p90 of the smallest absolute error that any candidate reaches per sample."""
    least = predictions.groupBy("sample_id").agg(F.min(F.abs(_residual())).alias("e"))
    mean = least.agg(F.avg("e").alias("oracle_mae"))
    return attach_percentiles(mean, least, [], "e", {"oracle_median_ae": 0.5, "oracle_p90_ae": 0.9})


def pooled_mae(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("configuration", "role").agg(F.avg(F.abs(_residual())).alias("mae"))


def lowest_mae(predictions: DataFrame) -> DataFrame:
    """The candidate with the lowest pooled error; ties go to the first name."""
    candidates = pooled_mae(predictions).where(F.col("role") == "candidate")
    return candidates.agg(
        F.min_by("configuration", F.struct("mae", "configuration")).alias("configuration"), F.min("mae").alias("mae")
    )


def prediction_bounds(predictions: DataFrame) -> DataFrame:
    """Smallest and largest value over both observed and predicted, per configuration."""
    return predictions.groupBy("configuration").agg(
        F.least(F.min(OBSERVED), F.min(PREDICTED)).alias("low"),
        F.greatest(F.max(OBSERVED), F.max(PREDICTED)).alias("high"),
    )


def extremes_side_by_side(predictions: DataFrame, last_category: str = "B10") -> DataFrame:
    """mae and bias of the first and last category as columns, one row per configuration."""
    kept = predictions.where(F.col("category").isin("B1", last_category))
    r = _residual()
    return kept.groupBy("configuration").agg(
        *[
            expr
            for name in ("B1", last_category)
            for expr in (
                F.avg(F.when(F.col("category") == name, F.abs(r))).alias(f"{name.lower()}_mae"),
                F.avg(F.when(F.col("category") == name, r)).alias(f"{name.lower()}_bias"),
            )
        ]
    )


def category_profile(split: DataFrame, by: str = "category", target: str = "target") -> DataFrame:
    """Size, range, mean, median and sample deviation of the target, with the number of groups."""
    sums = split.groupBy(by).agg(
        F.count("*").alias("n"),
        F.min(target).alias("low"),
        F.max(target).alias("high"),
        F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("sd"),
        F.count_distinct("grp").alias("n_groups"),
    )
    return attach_percentiles(sums, split, [by], target, {"median": 0.5})


def poisson_bounds() -> list[int]:
    """Draws of 32 bits from which on a Poisson(1) weight is at least 1, 2, ...; the last is the largest that 32 bits reach."""
    sums = itertools.accumulate(math.exp(-1.0) / math.factorial(k) for k in range(20))
    return [b for b in (math.ceil(s * 2**32) for s in sums) if b < 2**32]


#: Rows whose weights for all resamples are drawn at once, as a share of so many cells.
DRAWN_CELLS = 1 << 20


def _scrambled(t: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 32-bit numbers, with products of less than 60 bits so that SQL can follow it."""
    for _ in range(2):
        t = (t ^ (t >> np.uint32(16))) * np.uint32(0x45D9F3B)
    return t ^ (t >> np.uint32(16))


def _seed_halves(text: str) -> tuple[int, int]:
    digest = hashlib.sha256(text.encode()).digest()
    return int.from_bytes(digest[:4], "big"), int.from_bytes(digest[4:8], "big")


def bootstrap_draws(errors: DataFrame, values: list[str], repeats: int, seed: int, key: str = "sample_id") -> DataFrame:
    """(rep, one mean for each of `values`) in each of `repeats` Poisson(1) resamples of the rows.

    A row's weights in all resamples come from 64 bits of its key's hash and 64 bits of each resample's, as a matrix for
    each piece of an Arrow batch; two products add it up, and a task hands on `repeats` rows of sums. No row is copied
    and none is placed, so the same rows give the same draws however they are dealt. A NULL value makes
    its means NaN.
    """
    bounds = np.array(poisson_bounds(), np.uint64).astype(np.uint32)
    halves = np.array([_seed_halves(f"{seed}:{r}:draw") for r in range(repeats)], np.uint32)
    schema = "rep int, weight double, " + ", ".join(f"v{k} double" for k in range(len(values)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((repeats, 1 + len(values)))
        step = max(1, DRAWN_CELLS // max(1, repeats))
        for batch in batches:
            high, low = (batch.column(k).to_numpy().astype(np.uint32) for k in range(2))
            own = np.stack([np.ones(batch.num_rows), *[batch.column(2 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(values))]], 1)
            for at in range(0, batch.num_rows, step):
                rows = slice(at, at + step)
                t = _scrambled(low[None, rows] ^ halves[:, 1:])
                t = _scrambled(t ^ high[None, rows] ^ halves[:, :1])
                weight = np.zeros(t.shape, np.float32)
                for bound in bounds:
                    weight += t >= bound
                sums += weight.astype(np.float64) @ own[rows]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(repeats), pa.int32()), *[pa.array(sums[:, k]) for k in range(sums.shape[1])]], names=[f.split()[0] for f in schema.split(", ")])

    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    tagged = errors.select(half(1).alias("high"), half(9).alias("low"), *[F.col(v).cast("double").alias(v) for v in values])
    sums = tagged.mapInArrow(partial, schema).groupBy("rep").agg(F.sum("weight").alias("weight"), *[F.sum(f"v{k}").alias(f"v{k}") for k in range(len(values))])
    return sums.select("rep", *[F.try_divide(F.col(f"v{k}"), F.col("weight")).alias(v) for k, v in enumerate(values)])


def bootstrap_interval(errors: DataFrame, value: str, repeats: int = 10_000, seed: int = 42) -> DataFrame:
    """Point mean with the 2.5 and 97.5 percentiles of its bootstrap distribution."""
    draws = bootstrap_draws(errors, [value], repeats, seed).agg(
        F.percentile(value, 0.025).alias("ci_low"), F.percentile(value, 0.975).alias("ci_high"),
        F.avg((F.col(value) < 0).cast("double")).alias("probability_below_zero"),
    )
    point = errors.agg(F.avg(value).alias("point"), F.avg((F.col(value) < 0).cast("double")).alias("fraction_below_zero"))
    return point.withColumn("_k", F.lit(0)).join(F.broadcast(draws.withColumn("_k", F.lit(0))), "_k").drop("_k")


def first_appearance_order(rows: DataFrame, name: str, ordinal: str) -> DataFrame:
    """Rank of each name by its first ordinal in the source."""
    first = rows.groupBy(name).agg(F.min(ordinal).alias("first"))
    # one row per configuration, a handful
    w = Window.partitionBy(F.lit(0)).orderBy("first")
    return first.select(name, F.row_number().over(w).cast("long").alias("place"))
