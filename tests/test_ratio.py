import pytest
from pyspark.sql import functions as F

from fleetratio.operators.expand import expand_single, expand_to_fleet
from fleetratio.operators.moments import (
    distinct_units,
    fleet_effort,
    observed_effort,
    sample_sizes,
    stratum_domain_moments,
    union_domains,
    zero_filled_bycatch,
)
from fleetratio.operators.ratio import ratio_table

STRATA = ["sector", "year"]


def small_sample(observer):
    return observer(
        dict(haul_id="h1", species="A", dis_mt=2.0, tgt_mt=0.0),
        dict(haul_id="h1", species="X", dis_mt=0.0, tgt_mt=10.0),
        dict(haul_id="h2", trip_id="t1", species="X", tgt_mt=20.0),
        dict(haul_id="h3", trip_id=None, drvid="v2", species="A", dis_mt=1.0, tgt_mt=30.0),
        # without haul: never in effort or bycatch
        dict(haul_id=None, species="A", dis_mt=100.0, tgt_mt=100.0),
    )


def test_ratio_by_hand(observer, by_key):
    got = by_key(ratio_table(small_sample(observer), STRATA, ["A", "B"]), "species")
    a, b = got["A"], got["B"]
    assert (a["total_expf"], a["mean_expf"]) == (60.0, 20.0)
    assert a["se_expf"] == pytest.approx((100 / 3) ** 0.5)
    assert (a["n_obs_ves"], a["n_obs_trips"], a["n_obs_hauls"]) == (2, 2, 3)
    assert (a["total_byc"], a["mean_byc"], a["n_hauls_byc"]) == (3.0, 1.0, 2)
    assert a["se_byc"] == pytest.approx((1 / 3) ** 0.5)
    assert a["byc_ratio"] == pytest.approx(0.05)
    assert a["pct_hauls_byc"] == 66.67
    assert a["byc_ratio_lower"] == pytest.approx(0.05 - 1.96 * a["byc_se"])
    # a domain never seen: zero bycatch, no standard error of the ratio
    assert (b["total_byc"], b["mean_byc"], b["se_byc"], b["byc_ratio"]) == (0.0, 0.0, 0.0, 0.0)
    assert b["byc_se"] is None and b["byc_ratio_lower"] is None


def test_one_haul_has_no_standard_error(observer, by_key):
    row = by_key(ratio_table(observer(dict(dis_mt=1.0, tgt_mt=4.0)), STRATA, ["A"]), "species")["A"]
    assert row["byc_ratio"] == 0.25
    assert row["se_byc"] is None and row["se_expf"] is None and row["byc_ratio_upper"] is None


def test_zero_effort_gives_null_ratio(observer, by_key):
    row = by_key(ratio_table(observer(dict(dis_mt=1.0, tgt_mt=0.0)), STRATA, ["A"]), "species")["A"]
    assert row["byc_ratio"] is None and row["byc_se"] is None


def test_effort_needs_analysis_data_but_bycatch_does_not(observer, by_key):
    ob = observer(
        dict(haul_id="h1", dis_mt=1.0, tgt_mt=10.0),
        dict(haul_id="h2", dis_mt=3.0, tgt_mt=10.0, datatype="Failed Data"),
    )
    row = by_key(ratio_table(ob, STRATA, ["A"]), "species")["A"]
    assert (row["total_expf"], row["n_obs_hauls"], row["total_byc"], row["n_hauls_byc"]) == (10.0, 1, 4.0, 2)
    row = by_key(ratio_table(ob, STRATA, ["A"], analysis_only=True), "species")["A"]
    assert (row["total_expf"], row["total_byc"], row["n_hauls_byc"]) == (10.0, 1.0, 1)


def test_stratum_without_analysis_data_keeps_bycatch_row(observer, by_key):
    ob = observer(dict(dis_mt=1.0, tgt_mt=10.0, datatype="Failed Data"))
    row = by_key(ratio_table(ob, STRATA, ["A"]), "species")["A"]
    assert row["total_byc"] == 1.0
    assert all(row[c] is None for c in ("total_expf", "n_obs_ves", "n_obs_trips", "n_obs_hauls", "byc_ratio", "pct_hauls_byc"))


def test_null_stratum_is_a_stratum(observer, landings, by_key):
    ob = observer(dict(sector=None, haul_id="h1", dis_mt=1.0, tgt_mt=2.0), dict(haul_id="h2", dis_mt=1.0, tgt_mt=4.0))
    fleet = landings(dict(sector=None, tgt_mt=10.0), dict(tgt_mt=100.0))
    got = by_key(expand_to_fleet(ob, fleet, STRATA, ["A"], cleanup=False), "sector")
    assert got[None]["est_byc"] == 5.0 and got["S"]["est_byc"] == 25.0


def test_groups_repeat_units_and_keep_null_group(observer, by_key):
    ob = observer(
        dict(haul_id="h1", species="A", grouping="north", dis_mt=2.0, tgt_mt=5.0),
        dict(haul_id="h2", species="A", grouping=None, dis_mt=4.0, tgt_mt=5.0),
        dict(haul_id="h3", species="X", grouping="x", tgt_mt=10.0),
        # a group known only from a record without haul still gets its zero row
        dict(haul_id=None, species="A", grouping="south", dis_mt=9.0, tgt_mt=9.0),
    )
    got = by_key(ratio_table(ob, STRATA, ["A", "B"], group_col="grouping"), "species", "grouping")
    assert set(got) == {("A", "north"), ("A", None), ("A", "south"), ("B", None)}
    assert [got["A", g]["total_byc"] for g in ("north", None, "south")] == [2.0, 4.0, 0.0]
    assert got["A", "north"]["mean_byc"] == pytest.approx(2 / 3)
    assert {r["total_expf"] for r in got.values()} == {20.0}
    assert got["B", None]["total_byc"] == 0.0


def test_group_totals_add_up_to_the_ungrouped_total(observer, by_key):
    rows = [dict(haul_id=f"h{i % 7}", grouping="ab"[i % 2], dis_mt=float(i), tgt_mt=1.0) for i in range(30)]
    ob = observer(*rows)
    whole = by_key(ratio_table(ob, STRATA, ["A"]), "species")["A"]
    parts = ratio_table(ob, STRATA, ["A"], group_col="grouping").collect()
    assert sum(r.total_byc for r in parts) == pytest.approx(whole["total_byc"])


def test_units_are_haul_trip_vessel_but_hauls_are_counted_by_id(observer, by_key):
    ob = observer(
        dict(haul_id="h1", drvid="v1", dis_mt=1.0, tgt_mt=1.0), dict(haul_id="h1", drvid="v2", dis_mt=2.0, tgt_mt=1.0)
    )
    row = by_key(ratio_table(ob, STRATA, ["A"]), "species")["A"]
    assert (row["mean_byc"], row["n_hauls_byc"], row["n_obs_hauls"], row["n_obs_ves"]) == (1.5, 1, 1, 2)


def test_repartitioned_input_gives_the_same_table(observer, by_key):
    rows = [dict(haul_id=f"h{i % 11}", drvid=f"v{i % 3}", species="AB"[i % 2], dis_mt=i / 8, tgt_mt=i / 4) for i in range(80)]
    ob = observer(*rows)
    a = by_key(ratio_table(ob, STRATA, ["A", "B"]), "species")
    b = by_key(ratio_table(ob.repartition(7, "dis_mt"), STRATA, ["A", "B"]), "species")
    for s in a:
        assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in a[s].items()} == b[s]


def test_ratio_unchanged_by_common_scale(observer, by_key):
    ob = small_sample(observer)
    scaled = ob.withColumns({"dis_mt": F.col("dis_mt") * 8, "tgt_mt": F.col("tgt_mt") * 8})
    a = by_key(ratio_table(ob, STRATA, ["A"]), "species")["A"]
    b = by_key(ratio_table(scaled, STRATA, ["A"]), "species")["A"]
    assert a["byc_ratio"] == pytest.approx(b["byc_ratio"]) and a["byc_se"] == pytest.approx(b["byc_se"])


def test_nan_measure_is_missing(observer, by_key):
    ob = observer(dict(haul_id="h1", dis_mt=float("nan"), tgt_mt=2.0), dict(haul_id="h2", dis_mt=1.0, tgt_mt=float("nan")))
    row = by_key(ratio_table(ob, STRATA, ["A"]), "species")["A"]
    assert (row["total_byc"], row["total_expf"], row["byc_ratio"]) == (1.0, 2.0, 0.5)


def test_expansion_of_unobserved_and_unlanded_strata(observer, landings, by_key):
    ob = observer(dict(year=2020, dis_mt=1.0, tgt_mt=4.0), dict(year=2021, dis_mt=1.0, tgt_mt=4.0))
    fleet = landings(dict(year=2020, tgt_mt=8.0), dict(year=2022, tgt_mt=16.0), dict(year=2020, tgt_mt=None))
    raw = by_key(expand_to_fleet(ob, fleet, STRATA, ["A", "B"], cleanup=False), "year", "species")
    assert len(raw) == 6
    assert (raw[2020, "A"]["fleet_expf"], raw[2020, "A"]["est_byc"], raw[2020, "A"]["pct_cvg"]) == (8.0, 2.0, 50.0)
    assert raw[2021, "A"]["fleet_expf"] is None and raw[2021, "A"]["est_byc"] is None
    assert raw[2022, "B"]["fleet_expf"] == 16.0 and raw[2022, "B"]["total_byc"] is None
    clean = by_key(expand_to_fleet(ob, fleet, STRATA, ["A", "B"]), "year", "species")
    hole = clean[2022, "A"]
    assert (hole["pct_cvg"], hole["n_obs_ves"], hole["n_obs_trips"], hole["n_obs_hauls"]) == (0, 0, 0, 0)
    assert all(hole[c] is None for c in ("obs_byc", "obs_expf", "n_hauls_byc", "pct_hauls_byc", "byc_ratio", "est_byc", "est_byc_lower"))


def test_clean_lower_bound_is_not_below_observed(observer, landings, by_key):
    ob = observer(*[dict(haul_id=f"h{i}", dis_mt=float(i == 0), tgt_mt=1.0 + i) for i in range(5)])
    row = by_key(expand_to_fleet(ob, landings(dict(tgt_mt=20.0)), STRATA, ["A"]), "species")["A"]
    assert row["est_byc_lower"] == row["obs_byc"] == 1.0 and row["est_byc"] == 1.333


def test_group_label_is_repaired(observer, landings, by_key):
    ob = observer(dict(grouping="North of 40<b0>10", dis_mt=1.0, tgt_mt=4.0))
    fleet = landings(dict(tgt_mt=8.0), dict(year=2022, tgt_mt=1.0))
    got = by_key(expand_to_fleet(ob, fleet, STRATA, ["A"], group_col="grouping"), "year")
    assert got[2020]["grouping"] == "North of 40°10" and got[2022]["grouping"] is None


def test_single_column_estimate(observer, landings, by_key):
    ob = observer(
        dict(year=2020, haul_id="h1", dis_mt=1.0, tgt_mt=4.0), dict(year=2020, haul_id="h2", dis_mt=3.0, tgt_mt=4.0),
        dict(year=2021, haul_id="h1", dis_mt=1.0, tgt_mt=4.0),
        dict(year=2023, haul_id="h1", dis_mt=None, tgt_mt=4.0), dict(year=2023, haul_id="h2", dis_mt=1.0, tgt_mt=4.0),
        dict(year=2024, haul_id=None, dis_mt=0.0, tgt_mt=4.0, datatype="Failed Data"),
    )
    fleet = landings(dict(year=2020, tgt_mt=16.0), dict(year=2021, tgt_mt=8.0), dict(year=2022, tgt_mt=5.0),
                     dict(year=2023, tgt_mt=8.0), dict(year=2023, tgt_mt=None))
    got = by_key(expand_single(ob, fleet, STRATA, "tgt_mt", "dis_mt"), "year")
    assert (got[2020]["byc_ratio"], got[2020]["expand_byc"], got[2020]["pct_cvg"]) == (0.5, 8.0, 50.0)
    # one haul: missing SEs count as 0, so the bounds meet the ratio
    assert got[2021]["byc_se"] == 0.0 and got[2021]["byc_ratio_lower"] == got[2021]["byc_ratio_upper"] == 0.25
    assert got[2021]["expand_byc_lower"] == 2.0 and got[2021]["small_cell"]
    # no sample: totals 0, ratio undefined, bounds 0
    assert got[2022]["total_byc"] == 0.0 and got[2022]["byc_ratio"] is None and got[2022]["n_obs_ves"] == 0
    assert got[2022]["expand_byc_lower"] == got[2022]["expand_byc_upper"] == 0.0 and not got[2022]["small_cell"]
    # a missing bycatch value makes the total missing, hence 0; so does a missing landing
    assert got[2023]["total_byc"] == 0.0 and got[2023]["total_ft_expf"] == 0.0
    # nothing is filtered here, and a stratum without landings has effort 0
    assert got[2024]["n_obs_hauls"] == 1 and got[2024]["total_ft_expf"] == 0.0 and got[2024]["pct_cvg"] is None


def test_single_equals_multi_without_nulls(observer, landings, by_key):
    rows = [dict(haul_id=f"h{i}", drvid=f"v{i % 4}", dis_mt=i / 4, tgt_mt=1.0 + i) for i in range(12)]
    ob, fleet = observer(*rows), landings(dict(tgt_mt=500.0))
    one = by_key(expand_single(ob, fleet, STRATA, "tgt_mt", "dis_mt"), "year")[2020]
    multi = by_key(expand_to_fleet(ob, fleet, STRATA, ["A"], cleanup=False), "year")[2020]
    for c in ("total_byc", "mean_byc", "se_byc", "total_expf", "se_expf", "byc_ratio", "byc_se", "byc_ratio_upper"):
        assert one[c] == pytest.approx(multi[c]), c
    assert one["expand_byc"] == pytest.approx(multi["est_byc"])


def test_rollups(observer, landings, by_key):
    ob = small_sample(observer)
    assert observed_effort(ob, "sector").first().total_expf == 60.0
    assert sample_sizes(ob, "sector").first().n_obs_hauls == 4
    assert distinct_units(ob, "sector").count() == 3
    byc = by_key(zero_filled_bycatch(ob, "sector", ["A", "B"]), "species")
    assert byc["A"]["mean_byc"] == 1.0 and byc["B"]["n_hauls_byc"] == 0
    fleet = landings(dict(tgt_mt=1.0), dict(tgt_mt=None))
    assert fleet_effort(fleet, "sector").first().fleet_expf == 1.0
    assert fleet_effort(fleet, "sector", moments=True).first().total_ft_expf is None


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    assert {tuple(r) for r in union_domains([a, b]).collect()} == {(1, 2), (3, None)}


def test_dense_grid_gives_the_same_moments(observer, by_key):
    rows = [
        dict(haul_id=f"h{i % 9}", trip_id=f"t{i % 4}", drvid=f"v{i % 3}", species="ABCD"[i % 4], dis_mt=(i * 7 % 13) / 4,
             tgt_mt=1.0)
        for i in range(60)
    ]
    ob = observer(*rows)
    keys = ["haul_id", "trip_id", "drvid"]
    grid = ob.select(*keys).distinct().withColumn("species", F.explode(F.array(F.lit("A"), F.lit("B"))))
    caught = ob.groupBy(*keys, "species").agg(F.sum("dis_mt").alias("b"))
    dense = (
        grid.join(caught, [*keys, "species"], "left").fillna(0.0, ["b"]).groupBy("species")
        .agg(F.avg("b").alias("m"), F.sqrt(F.var_samp("b") / F.count("*")).alias("s"))
    )
    want = by_key(dense, "species")
    got = by_key(stratum_domain_moments(ob, "sector", ["A", "B"]), "species")
    for s in ("A", "B"):
        assert got[s]["mean_byc"] == pytest.approx(want[s]["m"], rel=1e-13)
        assert got[s]["se_byc"] == pytest.approx(want[s]["s"], rel=1e-13)
