"""Column expressions of the estimators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import divide, null_double

# Fixed value: two-sided 95 % normal quantile as used in the published estimates.
Z_95 = 1.96
# Fixed value: pounds in a metric ton, as used in the published estimates.
LB_PER_MT = 2204.6


def standard_error(value: Column, n: Column | None = None) -> Column:
    """Standard error of the mean; ``n`` defaults to the number of rows. NULL for one row."""
    return F.sqrt(divide(F.var_samp(value), F.count(F.lit(1)) if n is None else n))


def ratio_se(mean_num: Column, mean_den: Column, se_num: Column, se_den: Column) -> Column:
    """Delta-method standard error of a ratio of means; NULL where a mean is zero or missing."""
    ratio = divide(mean_num, mean_den)
    rel_num = F.pow(divide(se_num, mean_num), 2)
    rel_den = F.pow(divide(se_den, mean_den), 2)
    radicand = ratio * ratio * (rel_num + rel_den - rel_num * rel_den)
    return F.when(radicand >= 0, F.sqrt(radicand))


def stable_round(value: Column, digits: int) -> Column:
    """Half-up rounding that does not depend on the order in which a sum was added up.

    A sum of decimals carries noise far below the digits shown, which would decide ties such as
    0.2203125 at random; the first rounding removes it.
    """
    return F.round(F.round(value, digits + 4), digits)


def percent(num: Column, den: Column, digits: int | None = None) -> Column:
    """``num`` as a percentage of ``den``, rounded where ``digits`` is given."""
    value = divide(num.cast("double"), den.cast("double")) * 100
    return value if digits is None else stable_round(value, digits)


def clamp_lower(lower: Column, observed: Column) -> Column:
    """A lower bound not below what was observed; NULL where either is missing."""
    known = lower.isNotNull() & observed.isNotNull()
    return F.when(known, F.greatest(lower, observed))


def zero_filled_mean(mean: Column, n: Column, units: Column) -> Column:
    """Mean over ``units`` units of which only ``n`` (mean ``mean``) are non-empty, the rest zero."""
    return divide(n * mean, units)


def zero_filled_se(mean: Column, var_pop: Column, n: Column, units: Column) -> Column:
    """Standard error over ``units`` units, from the moments of the ``n`` non-empty ones.

    Pairwise update of the centred second moment by a block of zeros: no cancellation of large
    squares, and the zero rows never have to exist.
    """
    # With no unit at all the mean is unknown and the zeros add nothing.
    zeros = F.coalesce(mean * mean * n * divide(units - n, units), F.lit(0.0))
    second = var_pop * n + zeros
    return F.when(units > 1, F.sqrt(second / (units - 1) / units)).otherwise(null_double())


def expand_component(num: Column, den: Column, factor: Column) -> Column:
    """``num / den * factor``; an empty denominator gives 0 if nothing is to be expanded, else NULL."""
    nothing = (num == 0) | (factor == 0)
    return (
        F.when(num.isNull() | den.isNull() | factor.isNull(), null_double())
        .when((den == 0) & nothing, F.lit(0.0))
        .otherwise(divide(num, den) * factor)
    )
