"""Missing-value rules.

A measure has one missing value, NULL: NaN is turned into NULL on entry and every division is
``try_divide``, so no NaN or infinity arises later. Keys compare NULL equal to NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RIGHT = "__right_"


def null_double() -> Column:
    return F.lit(None).cast("double")


def measure(name: str) -> Column:
    """Column ``name`` as double with NaN read as missing."""
    return F.nanvl(F.col(name).cast("double"), null_double())


def is_true(cond: Column) -> Column:
    """Membership test semantics: an unknown condition counts as false."""
    return F.coalesce(cond, F.lit(False))


def divide(num: Column, den: Column) -> Column:
    """``num / den``, NULL when the denominator is zero or missing."""
    return F.try_divide(num, den)


def sum_or_zero(value: Column) -> Column:
    """Sum without missing values; 0 where nothing is left."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def strict_sum(value: Column, cond: Column | None = None) -> Column:
    """Sum of ``value`` over the rows where ``cond`` holds; NULL as soon as a row is uncertain.

    A row is uncertain when its condition is unknown, or holds while the value is missing.
    """
    if cond is None:
        cond = F.lit(True)
    uncertain = cond.isNull() | (cond & value.isNull())
    return F.when(~F.bool_or(is_true(uncertain)), sum_or_zero(F.when(cond, value)))


def n_distinct(value: Column, cond: Column | None = None) -> Column:
    """Distinct values where ``cond`` holds, a missing value counting as one value.

    Rows whose condition is unknown contribute one missing value.
    """
    if cond is None:
        cond = F.lit(True)
    has_missing = F.bool_or(is_true(cond.isNull() | (cond & value.isNull())))
    return F.count_distinct(F.when(cond, value)) + F.coalesce(has_missing, F.lit(False)).cast("long")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "full") -> DataFrame:
    """Equi-join on ``keys`` with NULL equal to NULL; each key appears once in the result.

    ``<=>`` stays an equi-join for the planner (hash or sort-merge), unlike an OR of null tests.
    """
    keys = list(keys)
    semi = how in ("left_semi", "left_anti")
    values = [] if semi else [c for c in right.columns if c not in keys]
    clash = sorted(set(values) & set(left.columns))
    if clash:
        raise ValueError(f"both sides have column(s): {', '.join(clash)}")
    renamed = right.select(*[F.col(k).alias(_RIGHT + k) for k in keys], *values)
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(_RIGHT + k)) for k in keys])
    joined = left.join(renamed, condition, how)
    if semi:
        return joined
    if how in ("full", "outer", "full_outer"):
        # Of a pair matched as NULL = NULL both sides are NULL, so coalesce is right there as well.
        out_keys = [F.coalesce(F.col(k), F.col(_RIGHT + k)).alias(k) for k in keys]
    elif how in ("right", "right_outer"):
        out_keys = [F.col(_RIGHT + k).alias(k) for k in keys]
    else:
        out_keys = [F.col(k) for k in keys]
    rest = [c for c in left.columns if c not in keys]
    return joined.select(*out_keys, *rest, *values)
