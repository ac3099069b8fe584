"""What reaches the scan, and how rows move."""

import re

import pytest

from fleetratio.operators.bootstrap import vessel_rollup
from fleetratio.operators.expand import expand_single, expand_to_fleet
from fleetratio.operators.moments import observed_effort, sample_sizes, zero_filled_bycatch
from fleetratio.operators.prepare import sector_filter
from fleetratio.operators.ratio import ratio_table
from fleetratio.operators.unsampled import ALWAYS, EXCLUDE_IF_PRESENT, expand_unsampled, nifq_haul_set


@pytest.fixture
def stored(spark, observer, tmp_path):
    path = str(tmp_path / "ob")
    observer({}, dict(haul_id="h2", species="B")).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    """(pushed filters, read columns) of every scan."""
    text = plan(df)
    pushed = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>(?:\n|$| )", text)
    return [(p, {c.split(":")[0] for c in s.split(",")}) for p, s in pushed]


def test_ratio_reads_its_columns_once(stored):
    found = scans(ratio_table(stored, ["sector", "year"], ["A"]))
    assert len(found) == 1
    pushed, columns = found[0]
    assert "IsNotNull(haul_id)" in pushed
    assert columns == {"sector", "year", "haul_id", "trip_id", "drvid", "datatype", "species", "dis_mt", "tgt_mt"}


def test_filters_reach_the_scan(stored):
    assert "EqualTo(datatype,Analysis Data)" in scans(observed_effort(stored, "sector"))[0][0]
    assert "EqualTo(datatype,Analysis Data)" in scans(zero_filled_bycatch(stored, "sector", ["A"], analysis_only=True))[0][0]
    assert "In(sector, [a,b])" in scans(sector_filter(stored, keep=["a", "b"]).select("sector"))[0][0]
    assert "Or(IsNull(sector),Not(EqualTo(sector,a)))" in scans(sector_filter(stored, drop=["a"]).select("sector"))[0][0]
    policy = {"A": EXCLUDE_IF_PRESENT, "E": ALWAYS}
    assert "catch_disposition" in scans(nifq_haul_set(stored, ["A", "E"], policy))[0][0]


def test_unsampled_expansion_scans(stored):
    """One whole scan feeds the sums by haul, trip and vessel; the others read only candidates; planning runs no job."""
    df = expand_unsampled(stored, ["sector", "year"], ["A", "E"], {"A": EXCLUDE_IF_PRESENT, "E": ALWAYS})
    found = scans(df)
    assert sorted(len(p) > 0 for p, _ in found) == [False, True, True, True]
    assert all("datatype" in p for p, _ in found if p)
    failed = [columns for p, columns in found if "EqualTo(datatype,Failed Data)" in p]
    assert failed == [{"trip_id", "datatype"}]
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", plan(df))) <= 20


def test_null_safe_joins_are_equi_joins(stored, landings):
    text = plan(expand_to_fleet(stored, landings({}), ["sector", "year"], ["A"]))
    assert "FullOuter" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_sums_combine_before_the_shuffle(stored):
    text = plan(vessel_rollup(stored, "sector", ["A", "B"]))
    assert text.count("Exchange") == 2 and "partial_sum" in text
    long = plan(vessel_rollup(stored, "sector", ["A", "B", *[f"none {i}" for i in range(38)]]))
    assert re.findall(r"\w+(?=\(| \[|\n)", long).count("HashAggregate") == re.findall(r"\w+(?=\(| \[|\n)", text).count("HashAggregate")


def test_units_meet_in_a_fixed_number_of_tasks(stored, landings):
    """Adaptive execution would merge millions of units into one task, which then holds several rows of each."""
    strata = ["sector", "year"]
    for df in (
        observed_effort(stored, strata),
        sample_sizes(stored, strata),
        ratio_table(stored, strata, ["A"]),
        expand_single(stored, landings({}), strata, "tgt_mt", "dis_mt"),
    ):
        assert re.search(r"hashpartitioning\(.*drvid#\d+.*, 4\), REPARTITION_BY_NUM", plan(df))
