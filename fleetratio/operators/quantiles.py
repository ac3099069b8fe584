"""Exact quantiles of many groups without holding a group's values in one buffer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import column_list, require_columns
from ..functions.nulls import measure, null_safe_join

# Value ranges to a factor of two; a range spans 0.3 % of its values.
RANGES_PER_DOUBLING = 256
# More than the ranges between the least and the greatest double.
_ABOVE = 2200 * RANGES_PER_DOUBLING


def value_range(value: Column) -> Column:
    """Number of the range a value lies in: rises with the value, 0 for zero alone."""
    place = F.floor(F.log2(F.abs(value)) * RANGES_PER_DOUBLING).cast("int") + _ABOVE
    return F.when(value == 0, F.lit(0)).when(value > 0, place).otherwise(-place)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str] | str,
    value: str,
    probabilities: Sequence[float],
    rows_per_group: int | None = None,
) -> DataFrame:
    """The ``keys`` with ``__q``, the quantiles in the given order (type 7), and ``__mean``.

    Rank selection: values are counted by range, and only the ranges that hold a wanted rank are opened; equal
    values are counted, not repeated. What a task holds depends on the ranges of a group, the opened ones are
    sorted and can spill. With ``rows_per_group`` a group has that many values, and those without a row are zero.
    Missing values do not count; a group without a value has no row.
    """
    keys = column_list(keys)
    require_columns(df, [*keys, value], "table")
    values = df.select(*keys, measure(value).alias("__v")).where(F.col("__v").isNotNull())
    values = values.withColumn("__range", value_range(F.col("__v")))
    counted = values.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"), F.sum("__v").alias("__sum"))
    if rows_per_group is not None:
        seen = counted.groupBy(*keys).agg(F.sum("__n").alias("__n"))
        silent = seen.select(*keys, F.lit(0).alias("__range"), (F.lit(rows_per_group) - F.col("__n")).alias("__n"), F.lit(0.0).alias("__sum"))
        counted = counted.unionByName(silent).groupBy(*keys, "__range").agg(F.sum("__n").alias("__n"), F.sum("__sum").alias("__sum"))

    group = Window.partitionBy(*keys)
    below = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select(
        *keys,
        "__range",
        "__n",
        F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__below"),
        F.sum("__n").over(group).alias("__total"),
        (F.sum("__sum").over(group) / F.sum("__n").over(group)).alias("__mean"),
    )
    spots = [(F.col("__total") - 1) * F.lit(float(p)) for p in probabilities]
    ranks = [bound(spot) for spot in spots for bound in (F.floor, F.ceil)]

    def holds(first: Column, n: Column) -> Column:
        return reduce(lambda a, b: a | b, [(r >= first) & (r < first + n) for r in ranks])

    opened = placed.where(holds(F.col("__below"), F.col("__n"))).select(*keys, "__range", "__n", "__below", "__total", "__mean")
    zeros = opened.where(F.col("__range") == 0).select(*keys, F.lit(0.0).alias("__v"), "__n", F.col("__below").alias("__first"), "__total", "__mean")
    inside = opened.where(F.col("__range") != 0).drop("__n")
    distinct = null_safe_join(values, inside, [*keys, "__range"], "inner").groupBy(*keys, "__range", "__v", "__below", "__total", "__mean").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("__below") + F.coalesce(F.sum("__n").over(before), F.lit(0))
    found = distinct.select(*keys, "__v", "__n", first.alias("__first"), "__total", "__mean").unionByName(zeros)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__first")) & (rank < F.col("__first") + F.col("__n")), F.col("__v")))

    names = [f"__at{k}" for k in range(len(ranks))]
    picked = found.groupBy(*keys, "__total", "__mean").agg(*[at(r).alias(n) for r, n in zip(ranks, names)])
    between = [
        F.col(names[2 * k]) + (spot - F.floor(spot)) * (F.col(names[2 * k + 1]) - F.col(names[2 * k])) for k, spot in enumerate(spots)
    ]
    return picked.select(*keys, F.array(*between).alias("__q"), "__mean")
