import hashlib
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetratio.functions import draws
from fleetratio.operators import bootstrap
from fleetratio.operators.bootstrap import (
    boot_replicates,
    boot_summary,
    bootstrap_expand,
    bootstrap_ratio,
    vessel_rollup,
)


def vessels(observer, n=9, sector="S", extra=()):
    rows = [
        dict(sector=sector, haul_id=f"h{i}", drvid=f"v{i:02d}", species="AB"[i % 2], dis_mt=float(i), tgt_mt=10.0 + i)
        for i in range(n)
    ]
    return observer(*rows, *extra)


def md5_number(seed, salt, node, rep, j):
    digest = hashlib.md5(f"{seed}|{salt}|{node}|{rep}|{j // 4}".encode()).hexdigest()
    return int(digest[8 * (j % 4) : 8 * (j % 4) + 8], 16)


def xxhash_number(seed, salt, node, rep, j):
    """Half of the hash of five values in a row: each is hashed with the hash before it as seed."""
    h = 42
    for part in (struct.pack("<q", seed), salt.encode(), *(struct.pack("<q", v) for v in (node, rep, j // 2))):
        h = xxhash.xxh64_intdigest(part, h)
    return h & 0xFFFFFFFF if j % 2 else h >> 32


NUMBERS = {"md5": md5_number, "xxhash64": xxhash_number}


def brute_force(salt, units, replicates, seed=42, sampler="md5", node=4096):
    """Ratios of all replicates in plain Python; ``units`` maps the key text of a vessel to (effort, bycatch)."""
    values = [units[k] for k in sorted(units, key=lambda k: (hashlib.md5(k.encode()).hexdigest(), k))]
    n, out, number = len(values), [], NUMBERS[sampler]
    for r in range(1, replicates + 1):
        shares = Counter(number(seed, salt, -1, r, j) % n // node for j in range(n)) if n > node else {0: n}
        places = [k * node + number(seed, salt, k, r, j) % min(node, n - k * node) for k, share in shares.items() for j in range(share)]
        out.append(sum(values[p][1] for p in places) / sum(values[p][0] for p in places))
    return out


NINE = {f"Vv{i:02d}": (10.0 + i, float(i) if i % 2 == 0 else 0.0) for i in range(9)}


@pytest.mark.parametrize("sampler", ["md5", "xxhash64"])
def test_draws_match_brute_force(observer, sampler):
    got = boot_replicates(vessels(observer), "sector", ["A"], replicates=25, sampler=sampler).orderBy("rep").collect()
    assert [r.rep for r in got] == list(range(1, 26))
    assert [r.ratio for r in got] == pytest.approx(brute_force("VS", NINE, 25, sampler=sampler))


@pytest.mark.parametrize("sampler", ["md5", "xxhash64"])
@pytest.mark.parametrize("node", [2, 4, 8])
def test_draws_of_a_tree_match_brute_force(observer, sampler, node):
    """Nodes of two, four and eight vessels of nine, the last node not full; chunks inside nodes and above them."""
    want = brute_force("VS", NINE, 25, sampler=sampler, node=node)
    for chunk_units in (1, 3, 100):
        got = boot_replicates(vessels(observer), "sector", ["A"], replicates=25, sampler=sampler, node_units=node, chunk_units=chunk_units)
        assert [r.ratio for r in got.orderBy("rep").collect()] == pytest.approx(want)


def test_draws_dealt_in_parts(observer, monkeypatch):
    monkeypatch.setattr(bootstrap, "DEAL_DRAWS", 4)
    got = boot_replicates(vessels(observer), "sector", ["A"], replicates=9, sampler="md5", node_units=2).orderBy("rep").collect()
    assert [r.ratio for r in got] == pytest.approx(brute_force("VS", NINE, 9, node=2))


def test_hashes_are_linear_in_the_vessels(spark, observer):
    """A stratum of 40 nodes draws as often as it has vessels: each node its own share only."""
    n, node, reps = 320, 8, 10
    units = spark.range(n).select(F.lit("S").alias("sector"), F.col("id").cast("string").alias("drvid"), F.lit(1.0).alias("ves_expf"))
    entries = units.withColumn("__entries", F.array(F.struct(F.lit(0).alias("k"), F.lit(1.0).alias("v"))))
    sums = bootstrap._replicate_sums(entries, ["sector"], ["drvid"], reps, 42, "md5", node, node).collect()
    assert [r["__m"][0] for r in sums] == [float(n)] * reps
    sizes = spark.createDataFrame([("VS", n)], "__salt string, __n long")
    shares = bootstrap._node_shares(sizes, reps, 5, 42, "md5", node).collect()
    assert sum(d for r in shares for d in r["__shares"].values()) == n * reps
    assert {r["__node"] for r in shares} == set(range(n // node))


def test_summary_is_type_7_quantiles(observer):
    row = boot_summary(vessels(observer), "sector", ["A"], replicates=60, sampler="md5").first()
    want = brute_force("VS", NINE, 60)
    assert row.point_est_ratio == pytest.approx(sum([0, 2, 4, 6, 8]) / sum(10 + i for i in range(9)))
    assert (row.lower_ci, row.median_ratio, row.upper_ci) == pytest.approx(tuple(np.quantile(want, [0.025, 0.5, 0.975])))
    assert row.mean_ratio == pytest.approx(np.mean(want))


@pytest.mark.parametrize("sampler", ["md5", "xxhash64"])
def test_partitioning_does_not_change_draws(observer, sampler):
    ob = vessels(observer)
    a = boot_replicates(ob, "sector", ["A", "B"], replicates=30, sampler=sampler)
    b = boot_replicates(ob.repartition(5, "species"), "sector", ["A", "B"], replicates=30, sampler=sampler)
    assert {(r.species, r.rep): round(r.ratio, 12) for r in a.collect()} == {
        (r.species, r.rep): round(r.ratio, 12) for r in b.collect()
    }


def test_seed_changes_draws(observer):
    ob = vessels(observer)
    a = boot_replicates(ob, "sector", ["A"], replicates=10, seed=1).select("ratio").collect()
    b = boot_replicates(ob, "sector", ["A"], replicates=10, seed=2).select("ratio").collect()
    assert a != b


@pytest.mark.parametrize("sampler", ["md5", "xxhash64"])
def test_chunks_do_not_change_replicates(observer, sampler):
    """Draws and numbers of vessels do not know how a stratum is cut."""
    ob = vessels(observer, 12).unionByName(vessels(observer, 3, "T"))
    found = []
    for chunk_units in (3, 7, 50_000):
        got = boot_replicates(ob, "sector", ["A", "B"], replicates=40, sampler=sampler, chunk_units=chunk_units)
        found.append({(r.sector, r.species, r.rep): r.ratio for r in got.collect()})
    assert len(found[0]) == 2 * 2 * 40
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        assert all(other[k] == pytest.approx(v, rel=1e-12, abs=1e-12) for k, v in found[0].items())


def test_every_replicate_draws_n_of_n(observer):
    """With effort 1 per vessel every replicate must draw exactly n vessels, all of them sometimes."""
    rows = [dict(haul_id=f"h{i}", drvid=f"v{i:02d}", species="A", dis_mt=float(2 ** i), tgt_mt=1.0) for i in range(8)]
    got = boot_replicates(observer(*rows), "sector", ["A"], replicates=200, chunk_units=3).collect()
    assert len(got) == 200
    sums = [round(r.ratio * 8) for r in got]
    assert all(8 <= s <= 8 * 128 for s in sums)
    assert len(set(sums)) > 50
    assert sum(sums) / 200 == pytest.approx(255, rel=0.15)


def test_strata_with_separators_draw_apart(observer):
    """("a", "b|Vc") and ("a|Vb", "c") are different strata, so their draws differ."""
    rows = [
        dict(sector=s, gear=g, haul_id=f"h{i}", drvid=f"v{i}", species="A", dis_mt=float(2 ** i), tgt_mt=1.0)
        for s, g in (("a", "b|Vc"), ("a|Vb", "c"))
        for i in range(8)
    ]
    got = boot_replicates(observer(*rows), ["sector", "gear"], ["A"], replicates=20).collect()
    one, two = ([r.ratio for r in sorted(got, key=lambda r: r.rep) if r.sector == s] for s in ("a", "a|Vb"))
    assert len(one) == len(two) == 20 and one != two


def test_null_stratum_and_null_vessel(observer, landings, by_key):
    ob = observer(
        *[dict(sector=None, haul_id=f"h{i}", drvid=None if i == 2 else f"v{i}", dis_mt=1.0 * i, tgt_mt=4.0) for i in range(5)]
    )
    got = bootstrap_expand(ob, landings(dict(sector=None, tgt_mt=40.0)), "sector", ["A"], replicates=20, program="shore")
    row = got.collect()
    assert len(row) == 1 and row[0].sector is None
    assert row[0].point_est_ratio == pytest.approx(0.5) and row[0].est_byc == pytest.approx(20.0)
    assert row[0].lower_ci <= row[0].median_ratio <= row[0].upper_ci
    assert row[0].n_obs_ves == 5


def test_vessel_rollup_zero_fills(observer, by_key):
    got = by_key(vessel_rollup(vessels(observer, 3), "sector", ["A", "B"]), "drvid", "species")
    assert got["v01", "A"]["ves_byc"] == 0.0 and got["v01", "B"]["ves_byc"] == 1.0
    assert got["v01", "A"]["ves_expf"] == got["v01", "B"]["ves_expf"] == 11.0


def test_records_without_haul_count_for_vessels_only(observer):
    ob = observer(dict(haul_id="h1", dis_mt=1.0, tgt_mt=10.0), dict(haul_id=None, dis_mt=3.0, tgt_mt=10.0))
    row = bootstrap_ratio(ob, "sector", ["A"], replicates=5, program="shore").first()
    assert row.byc_ratio == pytest.approx(0.1) and row.point_est_ratio == pytest.approx(0.2)


def test_stratum_without_effort_has_no_interval(observer, landings, by_key):
    ob = observer(dict(sector="P", dis_mt=1.0, tgt_mt=2.0), dict(sector="Z", haul_id="h2", dis_mt=1.0, tgt_mt=0.0))
    fleet = landings(dict(sector="P", tgt_mt=4.0), dict(sector="Z", tgt_mt=4.0), dict(sector="U", tgt_mt=4.0))
    got = by_key(bootstrap_expand(ob, fleet, "sector", ["A"], replicates=5, program="shore"), "sector", "species")
    # as in the estimator this follows: the fleet row has no domain, the observed row no fleet effort
    assert set(got) == {("P", "A"), ("Z", "A"), ("Z", None), ("U", None)}
    assert got["Z", "A"]["lower_ci"] is None and got["Z", "A"]["total_byc"] == 1.0
    full = by_key(
        bootstrap_expand(ob, fleet, "sector", ["A"], replicates=5, program="shore", complete_domains=True),
        "sector", "species",
    )
    assert set(full) == {("P", "A"), ("Z", "A"), ("U", "A")}
    assert full["Z", "A"]["fleet_expf"] == 4.0 and full["U", "A"]["est_byc_lower_trunc"] is None


def test_finer_unit_strata_make_more_units(observer):
    ob = observer(
        *[dict(year=2020 + y, haul_id=f"h{v}", drvid=f"v{v}", dis_mt=float(v), tgt_mt=5.0 + y) for v in range(4) for y in range(2)]
    )
    want = brute_force("VS", {f"V{2020 + y}|Vv{v}": (5.0 + y, float(v)) for v in range(4) for y in range(2)}, 12)
    got = boot_replicates(ob, "sector", ["A"], unit_strata=["sector", "year"], replicates=12, sampler="md5")
    assert [r.ratio for r in got.orderBy("rep").collect()] == pytest.approx(want)
    with pytest.raises(ValueError, match="year"):
        boot_replicates(ob, ["sector", "year"], ["A"], unit_strata=["sector"])


def test_mean_is_near_the_point_estimate(observer):
    row = boot_summary(vessels(observer, 40), "sector", ["A"], replicates=2000).first()
    assert row.mean_ratio == pytest.approx(row.point_est_ratio, rel=0.02)
    assert row.lower_ci < row.point_est_ratio < row.upper_ci


def test_at_sea_program(observer):
    ob = observer(
        dict(sector="MOTHERSHIP", haul_id="h1", trip_id="t1", dis_mt=1.0, tgt_mt=1.0, pwht_mt=10.0, datatype=None),
        dict(sector="MOTHERSHIP", haul_id="h2", trip_id="t2", dis_mt=1.0, tgt_mt=1.0, pwht_mt=10.0, datatype="Failed Data"),
    )
    row = bootstrap_ratio(ob, "sector", ["A"], replicates=5, program="at_sea").first()
    assert (row.total_expf, row.n_obs_trips, row.n_obs_hauls) == (20.0, 1, 2)


def test_bad_arguments(observer):
    ob = vessels(observer, 2)
    with pytest.raises(ValueError, match="sampler"):
        boot_replicates(ob, "sector", ["A"], replicates=2, sampler="other")
    with pytest.raises(ValueError, match="positive"):
        boot_replicates(ob, "sector", ["A"], replicates=0)
    with pytest.raises(ValueError, match="repeated"):
        boot_replicates(ob, "sector", ["A", "A"])


def test_a_stratum_spreads_over_tasks(observer):
    df = boot_replicates(vessels(observer), "sector", ["A"], replicates=400)
    plan = df._jdf.queryExecution().executedPlan().toString()
    spread = re.search(r"hashpartitioning\(__salt#\d+, __node#\d+L?, __chunk#\d+L?, __block#\d+, (\d+)\), REPARTITION_BY_NUM", plan)
    assert spread and int(spread[1]) > 1


def test_long_domain_lists_share_the_draws(observer):
    ob = vessels(observer, 7)
    names = ["A", "B", *[f"none {i}" for i in range(40)]]
    args = dict(replicates=15, sampler="md5")
    short = {(r.species, r.rep): r.ratio for r in boot_replicates(ob, "sector", ["A", "B"], **args).collect()}
    long = {(r.species, r.rep): r.ratio for r in boot_replicates(ob, "sector", names, **args).collect()}
    assert len(long) == 42 * 15
    assert {k: long[k] for k in short} == pytest.approx(short)
    assert all(v == 0.0 for k, v in long.items() if k not in short)
    wide = {(r.drvid, r.species): r.ves_byc for r in vessel_rollup(ob, "sector", ["A", "B"]).collect()}
    rows = {(r.drvid, r.species): r.ves_byc for r in vessel_rollup(ob, "sector", names).collect()}
    assert {k: rows[k] for k in wide} == wide and len(rows) == 42 * 7


def test_numbers_of_whole_arrays_match_single_hashes():
    """Texts of one to three blocks, numbers of one to seven digits."""
    rng = np.random.default_rng(3)
    columns = [np.concatenate((rng.integers(0, top, 300), [0, top - 1])) for top in (2_000, 10_001, 3_000_000)]
    for salt in ("VASIA|V1995", "x" * 49, "é" * 70):
        found = draws.md5_numbers(f"42|{salt}|", columns)
        for i, (node, rep, number) in enumerate(zip(*columns)):
            assert [int(f[i]) for f in found] == [md5_number(42, salt, node, rep, 4 * int(number) + g) for g in range(4)]


def test_a_chunk_repeats_no_draws(observer):
    """Rows of work are cut by node and block of replicates, whatever the chunks, and no row is made for a hash or a draw."""
    df = boot_replicates(vessels(observer), "sector", ["A"], replicates=80, sampler="md5", chunk_units=1, node_units=4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "__hash" not in plan and "__number" not in plan
    # few bytes, much work: a number of tasks that adaptive execution does not merge
    assert re.search(r"hashpartitioning\(__salt#\d+, __block#\d+, __part#\d+L?, \d+\), REPARTITION_BY_NUM", plan)


@pytest.mark.parametrize("sampler", ["md5", "xxhash64"])
def test_pieces_of_nodes_match_brute_force(observer, monkeypatch, sampler):
    """Rows of work of three vessels: parts of a node of eight, one node of two."""
    monkeypatch.setattr(bootstrap, "PIECE_UNITS", 3)
    monkeypatch.setattr(draws, "SLICE", 5)
    for node, chunk_units in ((8, 2), (8, 8), (2, 1)):
        want = brute_force("VS", NINE, 12, sampler=sampler, node=node)
        got = boot_replicates(vessels(observer), "sector", ["A"], replicates=12, sampler=sampler, node_units=node, chunk_units=chunk_units)
        assert [r.ratio for r in got.orderBy("rep").collect()] == pytest.approx(want)
