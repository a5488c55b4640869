"""Exact ranks, quantile categories, stratified folds and nested subsets.

Nothing here puts a whole table into one task: ranks come from a range shuffle plus per-range
offsets, and positions inside a stratum from hash-prefix buckets plus offsets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.session import materialize

ROWS_PER_TASK = 2_000_000


def global_position(df: DataFrame, order: list[str], n: int | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add `position`, the exact 0-based rank by `order` (whose tuple must be unique).

    One range shuffle; rows are numbered inside each range and shifted by the sizes of the ranges
    before it. The numbered table is written out once, because a range shuffle samples its bounds
    and must not be evaluated twice.
    """
    n = df.count() if n is None else n
    parts = max(1, math.ceil(n / rows_per_task))
    ranged = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    stored = ranged if parts == 1 else materialize(ranged)[0]
    # one row per range: a window over at most `parts` rows
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    joined = stored.join(F.broadcast(offsets), "_part")
    return joined.withColumn("position", F.col("_offset") + F.col("_seq")).drop("_part", "_seq", "_offset")


def category_starts(n: int, k: int) -> list[int]:
    """First 0-based rank of categories 2..k under the rule min(i*k div n + 1, k)."""
    return [-(-j * n // k) for j in range(1, k)]


def quantile_category(
    df: DataFrame, k: int, target: str = "target", key: str = "sample_id", n: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add `category_no` (1..k): equal-count classes by rank of (target, key).

    Only the k-1 rows that open a class are needed, so the ranked table stays narrow and the class
    of each row is then a comparison with k-1 constants: no join, no shuffle of the wide rows.
    """
    n = df.count() if n is None else n
    if n == 0:
        return df.withColumn("category_no", F.lit(1))
    starts = category_starts(n, k)
    narrow = df.select(target, key)
    ranked = global_position(narrow, [target, key], n, rows_per_task)
    found = {r["position"]: r for r in ranked.where(F.col("position").isin(sorted(set(starts)))).collect()}
    types = dict(narrow.dtypes)
    row = F.struct(F.col(target).alias("t"), F.col(key).alias("k"))

    def at_or_after(start: int) -> Column:
        opening = found[start]
        bound = F.struct(
            F.lit(opening[target]).cast(types[target]).alias("t"), F.lit(opening[key]).cast(types[key]).alias("k")
        )
        return (row >= bound).cast("int")

    category = F.lit(1)
    for start in starts:
        category = category + at_or_after(start)
    return df.withColumn("category_no", category)


def hash_order(seed: Column | int, key: str = "sample_id") -> Column:
    """Deterministic shuffle key: sha256('seed:key')."""
    seed_text = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.sha2(F.concat_ws(":", seed_text, F.col(key).cast("string")), 256)


def prefix_digits(rows_per_group: float, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Hex digits of the hash that split a group of this size into task-sized buckets."""
    digits = 0
    while rows_per_group / 16**digits > rows_per_task and digits < 64:
        digits += 1
    return digits


def position_in_group(
    df: DataFrame, groups: list[str], order_hash: str, key: str, digits: int, name: str = "position"
) -> DataFrame:
    """Add the 0-based position by (hash, key) inside each group.

    With `digits` > 0 a group is cut into 16**digits hash buckets that are numbered separately and
    shifted by the sizes of the buckets before them; the bucket sizes are a small table.
    """
    if digits == 0:
        w = Window.partitionBy(*groups).orderBy(order_hash, key)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    bucketed = df.withColumn("_b", F.substring(order_hash, 1, digits))
    w = Window.partitionBy(*groups, "_b").orderBy(order_hash, key)
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        bucketed.groupBy(*groups, "_b")
        .agg(F.count("*").alias("_n"))
        .withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    numbered = bucketed.withColumn("_r", F.row_number().over(w))
    return (
        numbered.join(sizes, [*groups, "_b"])
        .withColumn(name, (F.col("_o") + F.col("_r") - 1).cast("long"))
        .drop("_b", "_r", "_o")
    )


def stratum_size(n: int, k: int) -> list[int]:
    """Rows before each category 1..k, from the rank rule alone."""
    return [0, *category_starts(n, k)]


def stratified_split(
    df: DataFrame, k: int = 10, folds: int = 5, seed: int = 42, target: str = "target", key: str = "sample_id",
    rows_per_task: int = ROWS_PER_TASK, n: int | None = None,
) -> DataFrame:
    """Add `category` (B1..Bk) and `fold` (1..folds).

    Rows are dealt to the folds in turn, in the order (category, hash of seed and key), so every
    fold, and every fold within a category, holds the floor or ceiling of its share.
    """
    n = df.count() if n is None else n
    with_category = quantile_category(df, k, target, key, n, rows_per_task)
    dealt = deal_folds(with_category, n, k, folds, F.lit(str(seed)), key=key, rows_per_task=rows_per_task)
    return dealt.withColumn("category", F.concat(F.lit("B"), F.col("category_no").cast("string"))).drop("category_no")


def deal_folds(
    df: DataFrame, n: int, k: int, folds: int, seed: Column, groups: tuple[str, ...] = (), key: str = "sample_id",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Deal rows that carry `category_no`; `groups` (for example a seed column) deal separately."""
    hashed = df.withColumn("_h", hash_order(seed, key))
    digits = prefix_digits(n / k, rows_per_task)
    placed = position_in_group(hashed, [*groups, "category_no"], "_h", key, digits, "_p")
    offsets = F.array(*[F.lit(v).cast("long") for v in stratum_size(n, k)])
    start = F.element_at(offsets, F.col("category_no"))
    return placed.withColumn("fold", (F.pmod(start + F.col("_p"), F.lit(folds)) + 1).cast("int")).drop("_h", "_p")


def outer_roles(split: DataFrame, folds: int = 5) -> DataFrame:
    """One row per sample and outer fold with its role, without a join."""
    every = F.sequence(F.lit(1), F.lit(folds))
    return split.withColumn("outer_fold", F.explode(every)).withColumn(
        "role", F.when(F.col("fold") == F.col("outer_fold"), F.lit("held_out")).otherwise(F.lit("train"))
    )


def training_rows(split: DataFrame, folds: int = 5) -> DataFrame:
    """One row per sample and outer fold that trains on it."""
    others = F.filter(F.sequence(F.lit(1), F.lit(folds)), lambda f: f != F.col("fold"))
    return split.withColumn("outer_fold", F.explode(others))


def apportion(counts: DataFrame, within: list[str], count: str, total: str, order: str, name: str) -> DataFrame:
    """Largest-remainder shares of `total` over the rows of each `within` group, in integers.

    The input is a table of group sizes (strata), not of samples.
    """
    whole = Window.partitionBy(*within)
    all_n = F.sum(count).over(whole)
    staged = (
        counts.withColumn("_all", all_n)
        .withColumn("_base", F.expr(f"({total} * {count}) div _all"))
        .withColumn("_rest", F.expr(f"({total} * {count}) % _all"))
        .withColumn("_left", F.col(total) - F.sum("_base").over(whole))
        .withColumn("_rank", F.row_number().over(whole.orderBy(F.desc("_rest"), F.col(order))))
    )
    share = F.col("_base") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)
    return staged.withColumn(name, share.cast("long")).drop("_all", "_base", "_rest", "_left", "_rank")


def _placed_training(split: DataFrame, seed: int, folds: int, key: str, n: int, k: int) -> DataFrame:
    hashed = training_rows(split, folds).withColumn(
        "_h",
        F.sha2(
            F.concat_ws(":", F.lit(str(seed)), F.col("outer_fold").cast("string"), F.col(key).cast("string")), 256
        ),
    )
    return position_in_group(hashed, ["outer_fold", "category"], "_h", key, prefix_digits(n / k), "_p").drop("_h")


def _training_counts(split: DataFrame, folds: int) -> DataFrame:
    """Training rows per (outer fold, category), from the small fold x category counts."""
    per_fold = split.groupBy("fold", "category").agg(F.count("*").alias("n"))
    return (
        training_rows(per_fold, folds).groupBy("outer_fold", "category").agg(F.sum("n").cast("long").alias("n_category"))
    )


def inner_holdout(
    split: DataFrame, n: int, fraction: float = 0.2, seed: int = 43, folds: int = 5, key: str = "sample_id", k: int = 10
) -> DataFrame:
    """Mark a stratified share of each outer training set as `stopping`, the rest as `selection`."""
    whole = Window.partitionBy("outer_fold")
    counts = _training_counts(split, folds).withColumn(
        "n_stop", F.ceil(F.sum("n_category").over(whole) * F.lit(fraction)).cast("long")
    )
    quota = apportion(counts, ["outer_fold"], "n_category", "n_stop", "category", "quota")
    placed = _placed_training(split, seed, folds, key, n, k)
    return (
        placed.join(F.broadcast(quota.select("outer_fold", "category", "quota")), ["outer_fold", "category"])
        .withColumn("inner_role", F.when(F.col("_p") < F.col("quota"), "stopping").otherwise("selection"))
        .drop("_p", "quota")
    )


def nested_subsets(
    split: DataFrame, n: int, seed: int = 45, folds: int = 5, key: str = "sample_id", k: int = 10
) -> DataFrame:
    """Training rows of each outer fold repeated for every fraction 0.5, 0.75, 1.0 that holds them.

    Sizes are round-half-even(n * fraction); the half set is drawn from the three-quarter set.
    """
    whole = Window.partitionBy("outer_fold")
    total = F.sum("n_category").over(whole)
    counts = (
        _training_counts(split, folds)
        .withColumn("n75", F.rint(total * 0.75).cast("long"))
        .withColumn("n50", F.rint(total * 0.5).cast("long"))
    )
    three = apportion(counts, ["outer_fold"], "n_category", "n75", "category", "q75")
    both = apportion(three, ["outer_fold"], "q75", "n50", "category", "q50")
    placed = _placed_training(split, seed, folds, key, n, k)
    held = F.filter(
        F.array(
            F.struct(F.lit(0.5).alias("fraction"), (F.col("_p") < F.col("q50")).alias("take")),
            F.struct(F.lit(0.75).alias("fraction"), (F.col("_p") < F.col("q75")).alias("take")),
            F.struct(F.lit(1.0).alias("fraction"), F.lit(True).alias("take")),
        ),
        lambda s: s["take"],
    )
    return (
        placed.join(F.broadcast(both.select("outer_fold", "category", "q75", "q50")), ["outer_fold", "category"])
        .withColumn("fraction", F.explode(F.transform(held, lambda s: s["fraction"])))
        .drop("_p", "q75", "q50")
    )


def fraction_subsets(
    split: DataFrame, n: int, fractions: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0), seed: int = 42, folds: int = 5,
    key: str = "sample_id", k: int = 10,
) -> DataFrame:
    """Independent stratified fractions of each outer training set, sizes floor(n * fraction)."""
    table = F.array(*[F.lit(f) for f in fractions])
    whole = Window.partitionBy("outer_fold", "fraction")
    counts = (
        _training_counts(split, folds)
        .withColumn("fraction", F.explode(table))
        .withColumn("n_take", F.floor(F.sum("n_category").over(whole) * F.col("fraction")).cast("long"))
    )
    quota = apportion(counts, ["outer_fold", "fraction"], "n_category", "n_take", "category", "quota")
    placed = _placed_training(split, seed, folds, key, n, k)
    return (
        placed.join(
            F.broadcast(quota.select("outer_fold", "category", "fraction", "quota")), ["outer_fold", "category"]
        )
        .where(F.col("_p") < F.col("quota"))
        .drop("_p", "quota")
    )


def repeated_splits(df: DataFrame, seeds: tuple[int, ...], k: int = 10, folds: int = 5, key: str = "sample_id") -> DataFrame:
    """The split for several seeds in one pass; the categories do not depend on the seed."""
    n = df.count()
    categorised = quantile_category(df, k, key=key, n=n)
    fanned = categorised.withColumn("split_seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    dealt = deal_folds(fanned, n, k, folds, F.col("split_seed"), ("split_seed",), key)
    return dealt.withColumn("category", F.concat(F.lit("B"), F.col("category_no").cast("string"))).drop("category_no")
