import pytest

from fleetratio.operators import unsampled
from fleetratio.operators.unsampled import ALWAYS, EXCLUDE_IF_PRESENT, expand_unsampled, failed_trips, nifq_haul_set

POLICY = {"A": EXCLUDE_IF_PRESENT, "E": ALWAYS}
LB = 2204.6


def base_rows():
    return [
        dict(haul_id="h1", trip_id="t1", species="A", ifq=0, mt=2.0, tgt_mt=0.0, exp_sp_ct=4.0, exp_sp_wt=LB),
        dict(haul_id="h1", trip_id="t1", species="E", ifq=1, mt=2.0, tgt_mt=0.0, exp_sp_ct=2.0, exp_sp_wt=2 * LB),
        dict(haul_id="h1", trip_id="t1", species="X", ifq=1, mt=4.0, tgt_mt=10.0, catch_disposition="R"),
        # unsampled non-IFQ catch: h2 has no A, h3 has
        dict(haul_id="h2", trip_id="t1", species="N", common_name="Non-IFQ Fish Species", ifq=0, mt=3.0,
             datatype="Unsampled IFQ"),
        dict(haul_id="h3", trip_id="t1", species="N", common_name="Non-IFQ Fish Species", ifq=0, mt=5.0,
             datatype="Unsampled IFQ"),
        dict(haul_id="h3", trip_id="t1", species="A", ifq=0, mt=0.0, datatype="Unsampled IFQ", tgt_mt=1.0),
        dict(haul_id="h4", trip_id="t2", species="N", common_name="Misc Mixed Species", mt=8.0, datatype="Unsampled ZMIS"),
        dict(haul_id="h4", trip_id="t2", species="N", common_name="Unsorted catch not sampled", mt=6.0,
             datatype="Unsampled ZMIS"),
        dict(haul_id=None, trip_id=None, drvid="v2", species="N", datatype="Failed Data", tgt_mt=5.0,
             catch_disposition="R"),
        dict(haul_id="h5", trip_id=None, drvid=None, species="N", mt=0.0, tgt_mt=2.0, catch_disposition="R"),
    ]


def test_components_by_hand(observer, by_key):
    got = by_key(expand_unsampled(observer(*base_rows()), "sector", ["A", "E"], POLICY), "bycsp")
    a, e = got["A"], got["E"]
    assert (a["nifq_num_ct"], a["nifq_num_wt"], e["fail_num_ct"], e["fail_num_wt"]) == (4.0, 1.0, 2.0, 2.0)
    assert (a["nifq_denom"], a["zmis_denom"], a["unst_denom"], a["fail_denom"]) == (2.0, 4.0, 8.0, 12.0)
    # h3 discarded A by name, so its non-IFQ weight is not expanded for A; E always expands
    assert (a["nifq_expf"], e["nifq_expf"]) == (3.0, 8.0)
    assert (a["zmis_expf"], a["unst_expf"]) == (8.0, 6.0)
    # all records of failed trips count, a missing trip being one trip
    assert a["fail_expf"] == 7.0
    assert a["est_nifq_ct"] == 6.0 and a["est_zmis_ct"] == 8.0 and a["est_unst_ct"] == 3.0
    assert a["est_fail_ct"] == pytest.approx(4 / 12 * 7)
    assert a["est_unsamp_ct"] == pytest.approx(17 + 28 / 12)
    assert a["total_byc_ct"] == pytest.approx(21 + 28 / 12)
    assert a["obs_byc_wt"] == 1.0


def test_coverage_columns(observer, by_key):
    a = by_key(expand_unsampled(observer(*base_rows()), "sector", ["A"], POLICY), "bycsp")["A"]
    # seen: analysis data, and unsampled IFQ of a named species
    assert (a["obs_tgt_mt"], a["unobs_tgt_mt"], a["total_tgt_mt"]) == (13.0, 5.0, 18.0)
    assert (a["obs_hauls"], a["unobs_hauls"], a["n_obs_ves"]) == (3, 4, 2)
    assert a["pct_tgt_obs"] == 72.2


def test_unknown_ifq_makes_the_denominator_unknown(observer, by_key):
    ob = observer(*base_rows(), dict(haul_id="h9", species="X", ifq=None, mt=1.0))
    a = by_key(expand_unsampled(ob, "sector", ["A"], POLICY), "bycsp")["A"]
    assert a["nifq_denom"] is None and a["est_nifq_ct"] is None and a["est_unsamp_ct"] is None
    assert a["est_zmis_ct"] is not None
    a = by_key(expand_unsampled(ob, "sector", ["A"], POLICY, na_policy="ignore"), "bycsp")["A"]
    assert a["nifq_denom"] == 2.0 and a["est_nifq_ct"] == 6.0


def test_unknown_names_and_weights(observer, by_key):
    ob = observer(
        dict(species="A", ifq=0, mt=1.0, exp_sp_ct=1.0), dict(species=None, ifq=0, mt=1.0, exp_sp_ct=1.0),
        dict(year=2021, species="A", ifq=0, mt=1.0, exp_sp_ct=None),
        dict(year=2022, species="A", ifq=0, mt=1.0, exp_sp_ct=1.0),
        # h7 is in the set through ifq = 0, its common name is unknown
        dict(year=2022, haul_id="h7", species="N", ifq=0, mt=1.0, common_name=None, datatype="Unsampled IFQ"),
    )
    got = by_key(expand_unsampled(ob, ["sector", "year"], ["A"], POLICY), "year")
    assert got[2020]["nifq_num_ct"] is None and got[2021]["nifq_num_ct"] is None
    assert got[2022]["nifq_num_ct"] == 1.0 and got[2022]["nifq_expf"] is None
    # a record of unknown class counts as one missing haul on both sides
    assert (got[2022]["obs_hauls"], got[2022]["unobs_hauls"]) == (2, 1)


def test_empty_denominators(observer, by_key):
    ob = observer(
        dict(species="X", ifq=1, mt=1.0, catch_disposition="R"),
        dict(haul_id="h2", species="N", common_name="Misc Mixed Species", mt=8.0, datatype="Unsampled ZMIS"),
        dict(year=2021, species="A", ifq=1, mt=0.0, exp_sp_ct=3.0),
        dict(year=2021, haul_id="h3", species="N", common_name="Misc Mixed Species", mt=8.0, datatype="Unsampled ZMIS"),
    )
    got = by_key(expand_unsampled(ob, ["sector", "year"], ["A"], POLICY), "year")
    assert got[2020]["est_zmis_ct"] == 0.0 and got[2020]["est_unsamp_ct"] == 0.0
    # fish, but no weight to relate them to: undefined, not 0; nothing to expand stays 0
    assert got[2021]["est_zmis_ct"] is None and got[2021]["est_nifq_ct"] == 0.0


def test_presence_is_by_haul_over_all_strata(observer, by_key):
    ob = observer(
        dict(year=2020, haul_id="h1", species="N", common_name="Non-IFQ Fish Species", ifq=0, mt=3.0, datatype="Unsampled IFQ"),
        dict(year=2021, haul_id="h1", species="A", ifq=0, mt=1.0, datatype="Unsampled ZMIS"),
    )
    got = by_key(expand_unsampled(ob, ["sector", "year"], ["A", "E"], POLICY), "year", "bycsp")
    assert got[2020, "A"]["nifq_expf"] == 0.0 and got[2020, "E"]["nifq_expf"] == 3.0


def test_null_haul_is_one_haul(observer, by_key):
    ob = observer(
        dict(haul_id=None, species="N", common_name="Non-IFQ Fish Species", mt=3.0, datatype="Unsampled IFQ"),
        dict(haul_id=None, drvid="v9", species="A", mt=1.0),
    )
    got = by_key(expand_unsampled(ob, "sector", ["A", "E"], POLICY), "bycsp")
    assert got["A"]["nifq_expf"] == 0.0 and got["E"]["nifq_expf"] == 3.0


def test_haul_set_and_failed_trips(observer):
    ob = observer(*base_rows())
    hauls = {(r.haul_id, r.species) for r in nifq_haul_set(ob, ["A", "E"], POLICY).collect()}
    assert hauls == {("h2", "A"), ("h2", "E"), ("h3", "E")}
    assert [r.trip_id for r in failed_trips(ob).collect()] == [None]


def test_unknown_domain_is_refused(observer):
    with pytest.raises(ValueError, match="X"):
        expand_unsampled(observer({}), "sector", ["X"])


def test_weight_from_counts(observer, by_key):
    ob = observer(*base_rows())
    a = by_key(expand_unsampled(ob, "sector", ["A"], POLICY, observed_weight_from_counts=True), "bycsp")["A"]
    assert a["obs_byc_wt"] == 4.0


def test_components_add_up(observer):
    for r in expand_unsampled(observer(*base_rows()), ["sector", "year"], ["A", "E"], POLICY).collect():
        for u in ("ct", "wt"):
            assert r[f"est_unsamp_{u}"] == pytest.approx(sum(r[f"est_{c}_{u}"] for c in ("nifq", "zmis", "unst", "fail")))


def test_records_without_target_catch_have_no_trip_row(observer):
    """Vessels carry the sums of the stratum, hauls their unsampled catch; a trip is there for target catch alone."""
    ob = observer(
        dict(haul_id="h1", trip_id="t1", tgt_mt=0.0, mt=2.0),
        dict(haul_id="h2", trip_id="t2", tgt_mt=3.0, mt=1.0),
        dict(haul_id="h3", trip_id="t3", tgt_mt=None, mt=1.0),
    )
    units = ("haul_id", "trip_id", "drvid")
    rows = unsampled._by_id(unsampled._record_values(ob, ["sector"], units, True), ["sector"], units, True).collect()
    assert sorted((r["__kind"], r["__id"]) for r in rows) == [
        ("haul", "h1"), ("haul", "h2"), ("haul", "h3"), ("trip", "t2"), ("trip", "t3"), ("vessel", "v1")
    ]
    by = {(r["__kind"], r["__id"]): r for r in rows}
    assert by["trip", "t2"]["__tgt"] == 3.0 and by["trip", "t3"]["__tgt"] is None
    assert by["vessel", "v1"]["unst_denom"] == 4.0 and by["vessel", "v1"]["fail_denom"] is None
