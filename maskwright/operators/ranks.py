"""Average ranks, pairwise correlations and their p-values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.session import materialize, work_partitions


#: A value held by more than this share of a series' rows is matched by broadcast: at most 1/share values per series.
HEAVY_SHARE = 0.001


def ranged_counts(rows: DataFrame, series: str, value: str) -> DataFrame:
    """(series, value, `_c`, `_before`): how often each value occurs and how many rows of its series are smaller.

    Equal values are counted first, so a value that a third of all rows share is one row by the time anything
    is sorted. Distinct values are sorted in ranges of (series, value) and shifted by the sizes of the series'
    earlier ranges. The ranged table is written once, because a range shuffle samples its bounds.
    """
    counts = rows.groupBy(series, value).agg(F.count("*").alias("_c"))
    parts = work_partitions(rows.sparkSession)
    stored, _ = materialize(counts.repartitionByRange(parts, series, value).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(series).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = stored.groupBy(series, "_part").agg(F.sum("_c").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy(series, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = stored.withColumn("_p", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    return placed.join(shift, [series, "_part"]).select(series, value, "_c", (F.col("_o") + F.col("_p")).alias("_before"))


def average_ranks(long: DataFrame, n: int) -> DataFrame:
    """(series, id, value) with `rank`: the mean 1-based rank of equal values inside each series.

    `n` is the number of rows per series. NULL values have no rank and are left out. The few values that many
    rows share are matched by broadcast, the others by their key, so no key of the join is hot.
    """
    ranked = ranged_counts(long.where("value IS NOT NULL"), "series", "value").select(
        "series", "value", "_c", (F.col("_before") + (F.col("_c") + 1) / 2.0).alias("rank")
    )
    ranked, _ = materialize(ranked)
    heavy = F.col("_c") > n * HEAVY_SHARE
    first = long.join(F.broadcast(ranked.where(heavy).drop("_c")), ["series", "value"], "left")
    rest = first.where("rank IS NULL").drop("rank").join(ranked.where(~heavy).drop("_c"), ["series", "value"])
    return first.where("rank IS NOT NULL").unionByName(rest)


def group_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles (linear interpolation) of `value` per group, one column per share.

    Every value's rank is known from `ranged_counts`, so the two values around a wanted rank are two conditional
    maxima: no group is gathered, whatever its size. NULL is a group like any other; a group without a value is
    not in the result (`attach_percentiles` gives it NULL).
    """
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    rows = df.where(F.col(value).isNotNull()).select(group.alias("_g"), F.col(value).cast("double").alias("_v"))
    ranked = ranged_counts(rows, "_g", "_v")
    after = F.col("_before") + F.col("_c")
    sizes = ranked.groupBy("_g").agg(F.max(after).alias("_n"))
    at = lambda rank: F.max(F.when((F.col("_before") <= rank) & (rank < after), F.col("_v")))
    aggregates = []
    for name, share in shares.items():
        rank = F.lit(float(share)) * (F.col("_n") - 1)
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        aggregates.append((low + F.max(rank - F.floor(rank)) * (high - low)).alias(name))
    found = ranked.join(sizes, "_g").groupBy("_g").agg(*aggregates)
    return found.select(*[F.col("_g")[c].alias(c) for c in by], *shares)


def melt(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for c in names])
    return df.select(F.col(key).alias("id"), F.inline(entries))


def rank_columns(df: DataFrame, key: str, names: list[str], n: int | None = None) -> DataFrame:
    """One row per key with the average rank of each column."""
    n = df.count() if n is None else n
    ranked = average_ranks(melt(df, key, names), n)
    return ranked.groupBy(F.col("id").alias(key)).agg(*[F.max(F.when(F.col("series") == c, F.col("rank"))).alias(c) for c in names])


def gram(df: DataFrame, columns: list[str], centre: list[float], by: str | None = None) -> DataFrame:
    """Sums of products of every column pair, (by, i, j, g) with i <= j, around `centre`.

    Each task adds up its Arrow batches with one matrix product and hands on p*p numbers per value
    of `by`, so the pairs never exist as rows and only tiny partial sums are shuffled.
    """
    means = np.array(centre)
    fields = [T.StructField("part", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("g", T.DoubleType())]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch[columns].to_numpy(dtype=np.float64) - means
            parts = batch["_by"].to_numpy()
            for part in np.unique(parts):
                x = values[parts == part]
                sums[int(part)] = sums.get(int(part), 0.0) + x.T @ x
        i, j = np.triu_indices(len(columns))
        for part, g in sums.items():
            yield pd.DataFrame({"part": part, "i": i.astype(np.int32), "j": j.astype(np.int32), "g": g[i, j]})

    tagged = df.select((F.col(by) if by else F.lit(0)).cast("long").alias("_by"), *[F.col(c).cast("double").alias(c) for c in columns])
    return tagged.mapInPandas(partial, T.StructType(fields)).groupBy("part", "i", "j").agg(F.sum("g").alias("g"))


def column_means(df: DataFrame, columns: list[str]) -> list[float]:
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [row[f"m{i}"] or 0.0 for i in range(len(columns))]


def pairwise_pearson(df: DataFrame, columns: list[str], name: str = "pearson") -> DataFrame:
    """(i, j, correlation) for every column pair i < j; NULL without variance or with missing values."""
    products = gram(df, columns, column_means(df, columns))
    # p*p numbers in all, so one row can hold them and no self-join is needed
    whole = products.groupBy("part").agg(F.collect_list(F.struct("i", "j", "g")).alias("all"))
    own = F.map_from_entries(F.transform(F.filter("all", lambda s: s["i"] == s["j"]), lambda s: F.struct(s["i"], s["g"])))
    pairs = whole.select(own.alias("own"), F.inline(F.filter("all", lambda s: s["i"] < s["j"])))
    value = F.try_divide(F.col("g"), F.sqrt(F.element_at("own", F.col("i")) * F.element_at("own", F.col("j"))))
    return pairs.select("i", "j", F.when(~F.isnan(value), value).alias(name))


@F.pandas_udf(T.DoubleType())
def two_sided_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """P-value of a correlation under the Student-t approximation with n - 2 degrees of freedom."""
    return pd.Series([_correlation_p(a, b) for a, b in zip(r, n)])


def _correlation_p(r: float, n: float) -> float | None:
    if r is None or n < 3 or math.isnan(r):
        return None
    if abs(r) >= 1:
        return 0.0
    # P(|T| > t) as an integral of (1 - u*u)^((n-4)/2) over |u| > |r|, by Gauss-Legendre after u = sin(a)
    power = n - 3
    nodes, weights = np.polynomial.legendre.leggauss(200)
    low, high = math.asin(abs(r)), math.pi / 2
    # most of the mass lies close to the lower end, so the range is cut in shrinking pieces
    edges = low + (high - low) * np.concatenate([[0.0], np.geomspace(1e-6, 1.0, 40)])
    total = 0.0
    for a, b in zip(edges[:-1], edges[1:]):
        at = (b - a) / 2 * nodes + (a + b) / 2
        total += (b - a) / 2 * float(weights @ np.cos(at) ** power)
    norm = math.exp(math.lgamma((power + 1) / 2) - math.lgamma(power / 2 + 1)) * math.sqrt(math.pi)
    return min(1.0, 2 * total / norm)


def spearman(df: DataFrame, key: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(left, right, n, rho, p_value) for the given column pairs."""
    from maskwright.functions import pearson

    names = sorted({c for p in pairs for c in p})
    ranks = rank_columns(df, key, names)
    row = ranks.agg(F.count("*").alias("n"), *[pearson(F.col(a), F.col(b)).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    entries = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{k}").alias("rho")) for k, (a, b) in enumerate(pairs)])
    long = row.select("n", F.inline(entries))
    return long.withColumn("p_value", two_sided_p(F.col("rho"), F.col("n").cast("double")))


def strength(pearson: Column, spearman_: Column) -> Column:
    return F.greatest(F.abs(pearson), F.abs(spearman_))
