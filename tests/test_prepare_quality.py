import re

import pytest
from pyspark.sql import functions as F

from fleetratio.functions.stats import stable_round
from fleetratio.operators.expand import expand_to_fleet
from fleetratio.operators.prepare import (
    derive_fleet_strata,
    derive_observer_strata,
    detect_program,
    drop_empty_disposition,
    indicator_measure,
    numeric_year,
    program_normalise,
    restrict_to_sectors,
    round_measures,
    sector_filter,
    sectors_with_domain,
    zero_fill,
)
from fleetratio.operators.quality import (
    cell_range,
    coverage,
    differing_ranges,
    key_quality,
    partition_total,
    possible_members,
    reconcile,
    record_class_counts,
    row_counts,
    small_cells,
    ticket_match_rate,
    total_of_components,
    unobserved_strata,
    vessel_ticket_join,
)
from fleetratio.plans.requests import sector_request, species_request
from fleetratio.sources import read_fleet, read_observer, read_table, write_partitioned, write_result
from fleetratio.sources.checkpoints import checkpoint_dir


def test_derived_strata(spark):
    fleet = spark.createDataFrame([("C", 5), ("O", 10), ("W", 4), ("X", None), (None, 11)], "agency_code string, landing_month int")
    got = [(r.state, r.season) for r in derive_fleet_strata(fleet).collect()]
    assert got == [("CA", "summer"), ("OR", "summer"), ("WA", "winter"), (None, "winter"), (None, "winter")]
    ob = spark.createDataFrame([("CA", 6, "Trawl")], "r_state string, rmonth int, cs_gear string")
    assert tuple(derive_observer_strata(ob).first())[3:] == ("CA", "summer", "CS - Trawl")


def test_indicator_measure(spark):
    rows = [("A", "x", "D", 1.2), (None, "AA", "D", 2.0), ("B", "x", "D", 3.0), ("A", "x", "R", 4.0), ("A", "x", None, 5.0),
            (None, None, "D", 6.0)]
    df = spark.createDataFrame(rows, "species string, spid_eqv string, catch_disposition string, v double")
    got = [r.o for r in indicator_measure(df, "o", "v", "A", codes=["AA"], whole=True).collect()]
    assert got == [2.0, 2.0, 0.0, 0.0, None, 0.0]


def test_sector_filters_treat_null_as_no_member(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "sector string")
    assert [r.sector for r in sector_filter(df, keep=["a"]).collect()] == ["a"]
    assert [r.sector for r in sector_filter(df, drop=["a"]).collect()] == ["b", None]


def test_sectors_with_domain(observer):
    ob = observer(dict(sector="a", species="A"), dict(sector="b", species="B"), dict(sector="c", species=None))
    sectors = sectors_with_domain(ob, "A")
    assert [tuple(r) for r in sectors.collect()] == [("a", "G")]
    assert [r.sector for r in restrict_to_sectors(ob, sectors).collect()] == ["a"]


def test_program(observer):
    shore, sea = observer(dict(sector="S"), dict(datatype="Failed Data")), observer(dict(sector="ATSEA TRIBAL", pwht_mt=3.0))
    assert (detect_program(shore), detect_program(sea)) == ("shore", "at_sea")
    assert program_normalise(shore, "auto").count() == 1
    row = program_normalise(sea, "auto").first()
    assert (row.tgt_mt, row.trip_id) == (3.0, None)
    with pytest.raises(ValueError, match="unknown program"):
        program_normalise(shore, "other")


def test_small_helpers(spark, observer):
    assert drop_empty_disposition(observer(dict(catch_disposition=""), dict(catch_disposition=None), {})).count() == 1
    years = spark.createDataFrame([("2020",), ("x",)], "year string")
    assert [r.year for r in numeric_year(years).collect()] == [2020.0, None]
    df = spark.createDataFrame([(0.12345678, None, 7)], "k double, v double, n int")
    assert tuple(round_measures(df, ["v"], 3).first()) == (0.123, None, 7)
    assert tuple(zero_fill(df, ["k"]).first()) == (0.12345678, 0.0, 7)
    parts = spark.createDataFrame([(1.0, None, 2.0)], "a double, b double, c double")
    assert parts.select(total_of_components(["a", "b", "c"])).first()[0] == 3.0


def test_small_cells(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", None)], "s string, n_obs_ves int")
    assert {r.s for r in small_cells(df).collect()} == {"b", "c"}
    assert tuple(cell_range(df).first()) == (0, 3)


def test_ticket_match_rate(spark):
    ob = spark.createDataFrame([("T1;T2",), ("T1",), ("",), (None,), ("T3;",), ("T4;T4;T5",)], "fish_tickets string")
    fleet = spark.createDataFrame([("T1",), ("T1",), ("T3",), ("T9",), (None,)], "ftid string")
    assert tuple(ticket_match_rate(ob, fleet).first()) == (5, 2, 0.4)


def test_no_observed_ticket_gives_null_rate(spark):
    ob = spark.createDataFrame([("",)], "fish_tickets string")
    assert tuple(ticket_match_rate(ob, spark.createDataFrame([("T1",)], "ftid string")).first()) == (0, 0, None)


def test_landing_lines_are_tested_before_they_are_shuffled(spark):
    """Every id of the set passes, next to nothing else does, and a full set lets all pass without harm."""
    lines = spark.range(20_000).select(F.col("id").cast("string").alias("ftid"), F.lit(1.0).alias("mt"))
    lines = lines.unionByName(spark.createDataFrame([(None, 1.0)], "ftid string, mt double"))
    ids = spark.range(0, 20_000, 40).select(F.col("id").cast("string").alias("ftid"))
    passed = possible_members(lines, ids, "ftid")
    assert passed.columns == ["ftid", "mt"]
    assert {r.ftid for r in passed.collect()} == {str(i) for i in range(0, 20_000, 40)}
    narrow = [r.ftid for r in possible_members(lines, ids, "ftid", bits=4096).collect()]
    assert 500 < len(narrow) < 4_000 and {str(i) for i in range(0, 20_000, 40)} <= set(narrow)
    assert possible_members(lines, ids, "ftid", bits=1).count() == 20_000
    assert possible_members(lines, ids.where("false"), "ftid").count() == 0

    ob = ids.union(spark.createDataFrame([("T1;T2",), ("7;8;",), ("",), (None,)], "s string")).toDF("fish_tickets")
    for bits in (1, 64, 2**27):
        rate = ticket_match_rate(ob, lines, bits=bits)
        assert [tuple(r) for r in rate.collect()] == [(504, 502, 502 / 504)]
    assert "ReusedExchange" in rate._jdf.queryExecution().executedPlan().toString()


def test_coverage_and_partition_total(observer, landings, by_key):
    cov = coverage(observer(dict(tgt_mt=1.0)), landings(dict(tgt_mt=3.0), dict(year=2021, tgt_mt=1.0)), ["sector", "year"])
    got = by_key(cov, "year")
    assert got[2020]["pct_cvg"] == 33.33 and got[2021]["pct_cvg"] is None
    totals = partition_total(landings(dict(tgt_mt=3.0), dict(drvid=None, tgt_mt=1.0)), "sector", "tgt_mt")
    assert {(r.drvid, r.ves_total, r.stratum_total) for r in totals.collect()} == {("v1", 3.0, 4.0), (None, 1.0, 4.0)}


def test_vessel_ticket_join(observer, landings, by_key):
    ob = observer(dict(drvid="v1", tgt_mt=1.0, dis_mt=2.0), dict(drvid="v2", tgt_mt=1.0), dict(drvid="v3", tgt_mt=0.0))
    got = by_key(vessel_ticket_join(ob, landings(dict(tgt_mt=5.0)), "sector", "A", effort="tgt_mt"), "drvid")
    assert set(got) == {"v1", "v2"}
    assert got["v1"]["ves_fleet_expf"] == 5.0 and got["v2"]["ves_fleet_expf"] is None
    assert vessel_ticket_join(ob, landings(dict(tgt_mt=5.0)), "sector", "A", effort="tgt_mt", matched_only=True).count() == 1


def test_unobserved_strata(observer, landings, by_key):
    ob = observer(dict(tgt_mt=1.0))
    result = expand_to_fleet(ob, landings({}, dict(year=2021)), ["sector", "year"], ["A", "B"], cleanup=False)
    rows = unobserved_strata(result, ob, ["sector", "year"]).collect()
    assert [(r.year, r.has_sample) for r in rows] == [(2021, False)]


def test_reconcile(spark, by_key):
    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, 1.0), (None, 3.0, 1.0)], "k string, u double, v double")
    b = spark.createDataFrame([("x", 1.0 + 1e-9, None), ("z", 2.0, 1.0), (None, 4.0, 1.0)], "k string, u double, v double")
    got = by_key(reconcile(a, b, "k", ["u", "v"]), "k", "measure")
    assert {k for k, r in got.items() if r["agrees"]} == {("x", "u"), ("x", "v"), (None, "v")}
    assert reconcile(a, b, "k", ["u", "v"], mismatches_only=True).count() == 5
    assert tuple(row_counts(a, b.limit(2)).first()) == (3, 2, False)


def test_counts_and_keys(observer):
    ob = observer({}, dict(haul_id=None), dict(datatype="Failed Data", trip_id=None, haul_id=None))
    assert {(r.datatype, r.n) for r in record_class_counts(ob).collect()} == {("Analysis Data", 2), ("Failed Data", 1)}
    assert tuple(key_quality(ob).first()) == (3, 2, 1, 0)


def test_requests(spark, observer, landings):
    ob = observer(dict(sector="a", dis_mt=1.0, tgt_mt=2.0), dict(sector="b", species="B", tgt_mt=2.0), dict(sector="c")).withColumn(
        "r_state", F.lit("CA")
    )
    fleet = landings(dict(sector="a", tgt_mt=4.0), dict(sector="b", tgt_mt=4.0), dict(sector="c")).withColumn("agency_code", F.lit("C"))
    rows = species_request(ob, fleet, "A", drop_sectors=["c"]).collect()
    assert [(r.sector, r.state, r.est_byc) for r in rows] == [("a", "CA", 2.0)]
    rows = sector_request(ob, fleet, ["a", "b"], ["A", "B"]).collect()
    assert len(rows) == 4


def test_sources(spark, observer, tmp_path):
    path = str(tmp_path / "ob")
    write_result(observer({}).withColumnRenamed("haul_id", "HAUL_ID"), path)
    with pytest.raises(ValueError, match="haul_id"):
        read_observer(spark, path)
    assert read_observer(spark, path, tidy_names=True).count() == 1
    with pytest.raises(ValueError, match="schema"):
        read_table(spark, path, fmt="csv")
    write_result(spark.range(2), str(tmp_path / "c"), fmt="csv", header="true")
    assert read_table(spark, str(tmp_path / "c"), ["id"], fmt="csv", schema="id long", header="true").count() == 2


def test_checkpoint_dir_is_the_configured_one(spark):
    assert spark.sparkContext.getConf().get("spark.checkpoint.dir") in checkpoint_dir(spark)


def test_sector_restriction_runs_no_job_while_planning(spark, observer, landings):
    ob, fleet = observer(dict(species="A"), dict(sector="T", species="B")), landings({}, dict(sector="T")).withColumn("state", F.lit("CA"))
    ob = ob.withColumn("r_state", F.lit("CA"))
    group = "planning"
    spark.sparkContext.setJobGroup(group, group)
    report = species_request(ob, fleet, "A")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    assert {r.sector for r in report.collect()} == {"S"}
    by_year = species_request(ob, fleet, "A", strata=["year"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("other")
    assert by_year.count() == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_month_as_text_is_winter(spark):
    months = spark.createDataFrame([("May",), ("5",), ("6",), (None,)], "landing_month string")
    assert [r.season for r in derive_fleet_strata(months).collect()] == ["winter", "summer", "summer", "winter"]


def test_rounding_removes_noise_first(spark):
    """Half up at three digits after rounding to seven: a value within noise of a tie goes up."""
    values = spark.createDataFrame([(2.0005,), (2.00049999996,), (2.0004999,), (-2.0005,)], "x double")
    assert [r.y for r in values.select(stable_round(F.col("x"), 3).alias("y")).collect()] == [2.001, 2.001, 2.0, -2.001]


def test_sector_restriction_matches_missing_sectors(observer):
    ob = observer(dict(sector="a"), dict(sector="b"), dict(sector=None), dict(sector="c"))
    chosen = ob.where("sector in ('a', 'b') or sector is null")
    assert {r.sector for r in restrict_to_sectors(ob, chosen).collect()} == {"a", "b", None}
    assert restrict_to_sectors(ob, ob.where("false")).count() == 0


def test_a_hot_stratum_spreads_over_tasks_when_its_total_is_joined_back(spark):
    """A third of all vessels lies in one stratum, and no side can be broadcast."""
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 200).cast("string")))
    df = spark.range(60_000).select(hot.alias("sector"), F.col("id").cast("string").alias("drvid"), F.lit(1.0).alias("gfr_mt"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = partition_total(df, "sector").withColumn("task", F.spark_partition_id())
        rows = sorted(r["count"] for r in out.groupBy("task").count().collect())
        totals = {r.sector: r.t for r in out.groupBy("sector").agg(F.max("stratum_total").alias("t"), F.count("*").alias("n")).where("t <> n OR sector = 'hot'").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 16 and rows[-1] <= 2 * rows[8]
    assert totals == {"hot": 20_000.0}


def test_equal_tables_open_no_range(spark):
    rows = [(f"s{i % 7}" if i % 5 else None, i, float(i) if i % 3 else None) for i in range(300)]
    left = spark.createDataFrame(rows, "sector string, year int, x double")
    opened = differing_ranges(left, left.repartition(7), ["sector", "year"], "x")
    assert [df.count() for df in opened] == [0, 0]
    zeros = left.withColumn("x", F.when(F.col("x") == 1.0, F.lit(-0.0)).otherwise(F.col("x")))
    same = left.withColumn("x", F.when(F.col("x") == 1.0, F.lit(0.0)).otherwise(F.col("x")))
    assert [df.count() for df in differing_ranges(zeros, same, ["sector", "year"], "x")] == [0, 0]


def test_mismatches_are_found_in_the_ranges_that_differ(spark):
    rows = [(f"s{i % 7}" if i % 5 else None, i, float(i) if i % 3 else None) for i in range(300)]
    changed = [(s, y, 0.5 if y == 4 else None if y == 8 else 1.0 if y == 9 else x) for s, y, x in rows if y != 11] + [("new", 1, 2.0)]
    schema = "sector string, year int, x double"
    left, right = spark.createDataFrame(rows, schema), spark.createDataFrame(changed, schema)
    opened = differing_ranges(left, right, ["sector", "year"], "x")
    assert 4 <= opened[0].count() < 30
    got = reconcile(left, right, ["sector", "year"], "x", mismatches_only=True).collect()
    assert {(r.sector, r.year) for r in got} == {("s4", 4), ("s1", 8), ("s2", 9), ("s4", 11), ("new", 1)}
    # repeated rows and rows that cancel out under an exclusive or count as well
    twice = left.unionByName(left.where("year < 2")).unionByName(left.where("year < 2"))
    assert differing_ranges(left, twice, ["sector", "year"], "x")[1].count() >= 6
    # other key types are joined whole
    assert differing_ranges(left, right.withColumn("year", F.col("year").cast("long")), ["sector", "year"], "x")[0] is left


def test_readers_of_one_year_open_one_folder(spark, tmp_path):
    path = str(tmp_path / "by-year")
    df = spark.range(900).select((2000 + F.col("id") % 3).cast("int").alias("Year"), F.col("id").cast("string").alias("DRVID"), F.lit(1.0).alias("Tgt MT"))
    write_partitioned(df.repartition(5), path, "Year", files_per_value=2)
    assert sorted(p.name for p in (tmp_path / "by-year").glob("Year=*")) == ["Year=2000", "Year=2001", "Year=2002"]
    assert all(1 <= len(list(d.glob("*.parquet"))) <= 3 for d in (tmp_path / "by-year").glob("Year=*"))
    one = read_fleet(spark, path, required=["year", "drvid", "tgt_mt"], tidy_names=True).where(F.col("year") == 2001)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(Year#\d+\), \(Year#\d+ = 2001\)\]", plan)
    files = [r[0] for r in one.select(F.input_file_name()).distinct().collect()]
    assert one.count() == 300 and files and all("/Year=2001/" in f for f in files)


def test_a_year_too_large_for_a_task_is_split(spark, tmp_path):
    """All rows are of one year; the file number asked for is the least, what a task sorts stays bounded."""
    path, name = str(tmp_path / "one-year"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        write_partitioned(spark.range(4000).withColumn("year", F.lit(2000)), path, "year")
    finally:
        spark.conf.set(name, before)
    assert len(list((tmp_path / "one-year" / "year=2000").glob("*.parquet"))) > 1
    assert spark.read.parquet(path).distinct().count() == 4000
