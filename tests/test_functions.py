import math

import pytest
from pyspark.sql import functions as F

from fleetratio.functions import (
    clamp_lower,
    clean_names,
    divide,
    domain_list,
    expand_component,
    measure,
    n_distinct,
    null_safe_join,
    percent,
    ratio_se,
    require_columns,
    snake_case,
    stable_round,
    standard_error,
    strict_sum,
    zero_filled_mean,
    zero_filled_se,
)


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("HAUL_ID", "haul_id"), ("haulId", "haul_id"), ("Haul ID", "haul_id"), ("IFQGrouping", "ifq_grouping"),
        ("2002 total", "x2002_total"), ("% observed", "percent_observed"), ("# hauls", "number_hauls"),
        ("Fleet's effort", "fleets_effort"), ("a..b--c", "a_b_c"), ("  ", "x"), ("año", "ano"), ("DRVID", "drvid"),
    ],
)
def test_snake_case(raw, clean):
    assert snake_case(raw) == clean


def test_clean_names_makes_names_unique(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Year", "year ", "YEAR"])
    assert clean_names(df).columns == ["year", "year_2", "year_3"]


def test_missing_columns_are_listed(spark):
    df = spark.createDataFrame([(1,)], ["a"])
    with pytest.raises(ValueError, match="b, c"):
        require_columns(df, ["a", "b", "c"])


def test_domain_list_rejects_repeats_and_nothing():
    assert domain_list("A, with comma") == ["A, with comma"]
    with pytest.raises(ValueError, match="repeated"):
        domain_list(["A", "B", "A"])
    with pytest.raises(ValueError, match="at least one"):
        domain_list([])


def one(df, *columns):
    row = df.select(*columns) if columns else df
    return row.first()


def test_division_never_gives_nan_or_infinity(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (float("nan"), 2.0), (6.0, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(divide(measure("a"), measure("b"))).collect()]
    assert got == [None, None, None, 2.0]


def test_strict_sum_is_null_when_uncertain(spark):
    rows = [("ok", 1.0, True), ("ok", None, False), ("ok", 2.0, True), ("value", None, True), ("cond", 1.0, None),
            ("none", 5.0, False)]
    df = spark.createDataFrame(rows, "k string, v double, c boolean")
    got = {r.k: r.s for r in df.groupBy("k").agg(strict_sum(F.col("v"), F.col("c")).alias("s")).collect()}
    assert got == {"ok": 3.0, "value": None, "cond": None, "none": 0.0}


def test_n_distinct_counts_missing_once(spark):
    rows = [("a", None, True), ("a", None, True), ("a", "x", True), ("b", "x", True), ("b", "x", None),
            ("c", "x", False)]
    df = spark.createDataFrame(rows, "k string, v string, c boolean")
    got = {r.k: r.n for r in df.groupBy("k").agg(n_distinct(F.col("v"), F.col("c")).alias("n")).collect()}
    assert got == {"a": 2, "b": 2, "c": 0}


@pytest.mark.parametrize("how, expected", [("full", {("x", None, 1, 10), ("y", 1, 2, None), (None, 2, None, 20)}),
                                           ("left", {("x", None, 1, 10), ("y", 1, 2, None)}),
                                           ("right", {("x", None, 1, 10), (None, 2, None, 20)})])
def test_null_safe_join(spark, how, expected):
    left = spark.createDataFrame([("x", None, 1), ("y", 1, 2)], "a string, b int, l int")
    right = spark.createDataFrame([("x", None, 10), (None, 2, 20)], "a string, b int, r int")
    got = {tuple(r) for r in null_safe_join(left, right, ["a", "b"], how).select("a", "b", "l", "r").collect()}
    assert got == expected


def test_null_safe_semi_and_anti(spark):
    left = spark.createDataFrame([(None,), ("a",), ("b",)], "k string")
    right = spark.createDataFrame([(None,), ("b",)], "k string")
    assert {r.k for r in null_safe_join(left, right, ["k"], "left_semi").collect()} == {None, "b"}
    assert {r.k for r in null_safe_join(left, right, ["k"], "left_anti").collect()} == {"a"}


def test_null_safe_join_refuses_name_clash(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(ValueError, match="v"):
        null_safe_join(df, df, ["k"])


def test_standard_error(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 6.0), ("b", 4.0)], "k string, v double")
    got = {r.k: r.s for r in df.groupBy("k").agg(standard_error(F.col("v")).alias("s")).collect()}
    assert got["a"] == pytest.approx(math.sqrt(7 / 3))
    assert got["b"] is None


def test_ratio_se_by_hand(spark):
    df = spark.createDataFrame([(2.0, 4.0, 0.2, 0.4), (0.0, 4.0, 0.0, 0.4)], "x double, y double, sx double, sy double")
    got = [r[0] for r in df.select(ratio_se(*[F.col(c) for c in ("x", "y", "sx", "sy")])).collect()]
    assert got[0] == pytest.approx(0.5 * math.sqrt(0.01 + 0.01 - 0.0001))
    assert got[1] is None


def test_clamp_percent_and_rounding(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (None, 2.0), (3.0, None)], "lo double, obs double")
    assert [r[0] for r in df.select(clamp_lower(F.col("lo"), F.col("obs"))).collect()] == [2.0, 3.0, None, None]
    row = one(spark.range(1), percent(F.lit(1), F.lit(3), 2), percent(F.lit(1), F.lit(0)), stable_round(F.lit(0.22031249999999998), 6))
    assert tuple(row) == (33.33, None, 0.220313)


@pytest.mark.parametrize(
    "num, den, factor, expected",
    [(2.0, 4.0, 3.0, 1.5), (0.0, 0.0, 3.0, 0.0), (2.0, 0.0, 0.0, 0.0), (2.0, 0.0, 3.0, None), (None, 4.0, 1.0, None),
     (2.0, None, 1.0, None), (2.0, 4.0, None, None)],
)
def test_component_with_empty_denominator(spark, num, den, factor, expected):
    df = spark.createDataFrame([(num, den, factor)], "n double, d double, f double")
    assert df.select(expand_component(F.col("n"), F.col("d"), F.col("f"))).first()[0] == expected


def test_zero_filled_moments_equal_the_dense_ones(spark):
    some = [1.5, 4.0, 0.25, 1e6, 1e6 + 0.5]
    units = 12
    df = spark.createDataFrame([(v,) for v in some], "v double").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("p")
    )
    n, m, p, u = F.col("n"), F.col("m"), F.col("p"), F.lit(units)
    mean, se = df.select(zero_filled_mean(m, n, u), zero_filled_se(m, p, n, u)).first()
    dense = spark.createDataFrame([(v,) for v in some + [0.0] * (units - len(some))], "v double").agg(
        F.avg("v"), standard_error(F.col("v"))
    ).first()
    assert mean == pytest.approx(dense[0], rel=1e-13)
    assert se == pytest.approx(dense[1], rel=1e-13)
