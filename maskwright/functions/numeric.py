"""Scalar rules: rounding, formatting, seeds, effect classes and guarded statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PRACTICAL_MARGIN = 1.0
TIE_NUDGE = 1e-9


def r6(value: Column, digits: int = 6) -> Column:
    """Round for comparison between engines.

    The small nudge moves exact decimal ties, which engines round differently, off the tie; adding
    zero turns -0.0 into 0.0.
    """
    return F.round(value + F.lit(TIE_NUDGE), digits) + F.lit(0.0)


def half_up(value: Column) -> Column:
    """floor(x + 0.5): ties go towards positive infinity, also for negative values."""
    return F.floor(value + F.lit(0.5))


def half_even(value: Column) -> Column:
    """Nearest integer, ties to even, as a double."""
    return F.rint(value)


def fixed(value: Column, decimals: int = 6) -> Column:
    """Fixed-decimal text; NULL becomes the empty string as in the public tables."""
    v = value.cast("double")
    return F.when(v.isNull(), F.lit("")).otherwise(F.format_string(f"%.{decimals}f", v))


def significant(value: Column, digits: int = 12) -> Column:
    """Text with at most `digits` significant digits and no trailing zeros (C's %g)."""
    v = value.cast("double")
    exponent = F.substring_index(F.format_string(f"%.{digits - 1}e", v), "e", -1).cast("int")
    decimals = F.greatest(F.lit(0), F.lit(digits - 1) - exponent)
    plain = F.call_function("format_string", F.concat(F.lit("%."), decimals.cast("string"), F.lit("f")), v)
    mantissa = F.substring_index(F.format_string(f"%.{digits - 1}e", v), "e", 1)
    small_or_large = (exponent < -4) | (exponent >= digits)
    scientific = F.concat(_strip_zeros(mantissa), F.lit("e"), F.format_string("%+03d", exponent))
    return F.when(v.isNull(), F.lit("")).when(small_or_large, scientific).otherwise(_strip_zeros(plain))


def _strip_zeros(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def finite(value: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf))


def parse_number(text: Column) -> Column:
    """Text to double, a decimal comma accepted; anything else is NULL."""
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("double")


def permutation_seed(split_seed: int, fold: Column, feature: Column, repetition: Column) -> Column:
    """First four bytes, big-endian, of sha256('split:fold:feature:repetition')."""
    identity = F.concat_ws(":", F.lit(str(split_seed)), fold.cast("string"), feature, repetition.cast("string"))
    return F.conv(F.substring(F.sha2(identity, 256), 1, 8), 16, 10).cast("long")


def effect_class(delta: Column, margin: float = PRACTICAL_MARGIN) -> Column:
    """Three-way class; a delta of exactly +-margin is neutral, NULL stays NULL."""
    return (
        F.when(delta.isNull(), F.lit(None).cast("string"))
        .when(delta < -margin, F.lit("improvement"))
        .when(delta > margin, F.lit("harm"))
        .otherwise(F.lit("neutral"))
    )


def suffix_number(category: Column) -> Column:
    """B2 -> 2 and B10 -> 10, so that categories order by number."""
    return F.substring(category, 2, 10).cast("int")


def wrap_angle(degrees: Column) -> Column:
    """Wrap to [-90, 90)."""
    return F.pmod(degrees + F.lit(90.0), F.lit(180.0)) - F.lit(90.0)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate correlation; NULL (not an error) when one side has no variance."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def residual(observed: Column, predicted: Column) -> Column:
    """Predicted minus observed: positive means over-estimated."""
    return predicted - observed


def contains_any(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """Array of the terms found in a text, case-insensitively, in the given order."""
    lowered = F.lower(text)
    hits = F.array(*[F.when(F.contains(lowered, F.lit(t.lower())), F.lit(t)) for t in terms])
    return F.filter(hits, lambda t: t.isNotNull())


def best_epoch(values: Column, minimum_improvement: float = 0.1, patience: int = 20) -> Column:
    """Early-stopping rule over an ordered array of validation errors.

    The best value moves only when it improves by more than the minimum; the walk stops after
    `patience` stale steps. Returns the 1-based epoch of the best value (1 when none improves).
    """
    start = F.struct(
        F.lit(math.inf).alias("best"), F.lit(1).alias("epoch"), F.lit(0).alias("stale"), F.lit(0).alias("step")
    )

    def step(state: Column, value: Column) -> Column:
        live = state["stale"] < patience
        better = live & (state["best"] - value > minimum_improvement)
        return F.struct(
            F.when(better, value).otherwise(state["best"]).alias("best"),
            F.when(better, state["step"] + 1).otherwise(state["epoch"]).alias("epoch"),
            F.when(better, F.lit(0)).when(live, state["stale"] + 1).otherwise(state["stale"]).alias("stale"),
            (state["step"] + 1).alias("step"),
        )

    return F.aggregate(values, start, step, lambda state: state["epoch"])
