import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetratio.operators.quantiles import exact_quantiles, value_range

PROBS = [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]


def groups():
    rng = np.random.default_rng(4)
    out = {
        "one": [3.5],
        "two": [1.0, 2.0],
        "equal": [0.25] * 50,
        "zeros": [0.0] * 30 + [1e-3, 5.0],
        "mixed": [*rng.normal(0, 10, 400), 0.0, 0.0],
        "narrow": list(1 + rng.random(500) / 1000),
        "wide": list(10.0 ** rng.uniform(-300, 300, 300)),
        "tiny": [5e-324, 1e-310, -5e-324, 0.0],
        "huge": [1.7e308, -1.7e308],
        None: list(rng.random(77)),
    }
    return {k: [float(x) for x in v] for k, v in out.items()}


def test_quantiles_are_those_of_the_sorted_values(spark):
    rows = [(k, v) for k, values in groups().items() for v in values] + [("one", None), ("one", float("nan")), ("empty", None)]
    got = exact_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), "g", "x", PROBS).collect()
    assert {r.g for r in got} == set(groups())
    for r in got:
        values = groups()[r.g]
        if r.g != "huge":  # the difference of the two is beyond a double
            assert r["__q"] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-15)
            assert r["__mean"] == pytest.approx(np.mean(values), rel=1e-9, abs=1e-12)


def test_rows_that_are_not_there_are_zero(spark):
    rows = [("a", 2.0), ("a", 4.0), ("b", -1.0), ("b", 0.0)]
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double"), "g", "x", PROBS, rows_per_group=41).collect()}
    for g, values in (("a", [2.0, 4.0]), ("b", [-1.0, 0.0])):
        full = values + [0.0] * (41 - len(values))
        assert got[g]["__q"] == pytest.approx(list(np.quantile(full, PROBS))) and got[g]["__mean"] == pytest.approx(np.mean(full))


def test_ranges_rise_with_the_value(spark):
    rng = np.random.default_rng(5)
    values = sorted({0.0, 5e-324, -5e-324, 1.7e308, *rng.normal(0, 1, 3000), *(2.0 ** rng.uniform(-1070, 1020, 3000)), *np.nextafter(np.float64(2.0) ** np.arange(-60, 60), 0)})
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    ranges = [r.n for r in df.select("x", value_range(F.col("x")).alias("n")).orderBy("x").collect()]
    assert ranges == sorted(ranges) and (np.array(ranges) == 0).sum() == 1


def test_only_opened_ranges_are_joined(spark):
    """Nothing gathers the values of a group: no percentile, no collected list."""
    plan = exact_quantiles(spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("x")), "g", "x", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan
