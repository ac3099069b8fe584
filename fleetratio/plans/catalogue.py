"""Registered queries: every operator on the whole tables of one folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import clean_names
from ..functions.nulls import divide, measure, null_safe_join, strict_sum
from ..functions.stats import clamp_lower, percent, ratio_se, stable_round, standard_error
from ..operators.bootstrap import (
    boot_replicates,
    bootstrap_expand,
    bootstrap_ratio,
    vessel_rollup,
)
from ..operators.expand import expand_single, expand_to_fleet, repair_label
from ..operators.moments import (
    distinct_units,
    fleet_effort,
    observed_effort,
    sample_sizes,
    union_domains,
    zero_filled_bycatch,
)
from ..operators.prepare import (
    derive_fleet_strata,
    derive_observer_strata,
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
from ..operators.quality import (
    cell_range,
    coverage,
    flag_small_cells,
    key_quality,
    partition_total,
    reconcile,
    record_class_counts,
    row_counts,
    ticket_match_rate,
    total_of_components,
    unobserved_strata,
    vessel_ticket_join,
)
from ..operators.ratio import ratio_table
from ..operators.unsampled import ALWAYS, EXCLUDE_IF_PRESENT, expand_unsampled, failed_trips, nifq_haul_set
from ..sources.checkpoints import shared_folder
from ..sources.fixtures import fleet_view, observer_view, table
from ..sources.tables import read_fleet, read_observer, read_table, write_partitioned, write_result
from .requests import sector_request, species_request

SYG = ["sector", "year", "gear"]
SY = ["sector", "year"]
UNITS = ["haul_id", "trip_id", "drvid"]
DOMAINS = ["PROMO", "SMALL"]
POLICY = {"PROMO": EXCLUDE_IF_PRESENT, "SMALL": ALWAYS}
SPECIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
# species by sector, and ten that never occur: a list of 40
FORTY = [f"{s} {r}" for s in SPECIES for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")] + [f"NEVER {i}" for i in range(10)]
SAMPLE = [*SYG, *UNITS, "datatype"]
MD5 = {"sampler": "md5", "seed": 42}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(key: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[key] = fn
        return fn

    return add


@register("ratio_est_single")
def ratio_est_single(spark, sf_dir):
    cols = [*SY, *UNITS, "datatype", "species", "catch_disposition", "dis_mt", "tgt_mt"]
    ob = observer_view(spark, sf_dir, cols).where(F.col("datatype") == "Analysis Data")
    ob = indicator_measure(ob, "promo_mt", "dis_mt", "PROMO")
    fleet = fleet_view(spark, sf_dir, [*SY, "tgt_mt"])
    return round_measures(expand_single(ob, fleet, SY, "tgt_mt", "promo_mt"), SY)


@register("ratio_multi")
def ratio_multi(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SAMPLE, "species", "tgt_mt", "dis_mt"])
    return round_measures(ratio_table(ob, SYG, DOMAINS), SYG)


@register("ratio_multi_groups")
def ratio_multi_groups(spark, sf_dir):
    keys = ["year", "gear"]
    ob = observer_view(spark, sf_dir, [*keys, *UNITS, "datatype", "species", "grouping", "gfr_mt", "dis_mt"])
    out = ratio_table(ob, keys, ["PROMO", "LARGE"], effort="gfr_mt", group_col="grouping")
    return round_measures(out, keys)


@register("expand_multi_raw")
def expand_multi_raw(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SAMPLE, "species", "tgt_mt", "dis_mt"])
    fleet = fleet_view(spark, sf_dir, [*SYG, "tgt_mt"])
    return round_measures(expand_to_fleet(ob, fleet, SYG, DOMAINS, cleanup=False), SYG)


@register("expand_multi_clean")
def expand_multi_clean(spark, sf_dir):
    keys = ["year", "gear", "sector", "state"]
    ob = observer_view(spark, sf_dir, [*SAMPLE, "r_state", "species", "tgt_mt", "dis_mt"])
    fleet = fleet_view(spark, sf_dir, [*SYG, "agency_code", "tgt_mt"])
    return expand_to_fleet(derive_observer_strata(ob), derive_fleet_strata(fleet), keys, DOMAINS)


@register("expand_multi_groups")
def expand_multi_groups(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SAMPLE, "species", "grouping", "tgt_mt", "dis_mt"])
    fleet = fleet_view(spark, sf_dir, [*SYG, "tgt_mt"])
    return expand_to_fleet(ob, fleet, SYG, DOMAINS, group_col="grouping")


@register("species_request")
def species_request_expanded(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SAMPLE, "r_state", "species", "tgt_mt", "dis_mt"])
    fleet = fleet_view(spark, sf_dir, [*SYG, "agency_code", "tgt_mt"])
    return species_request(ob, fleet, "PROMO", drop_sectors=["AFRICA"])


@register("request_six_species")
def request_of_six_species(spark, sf_dir):
    """Counts of six species by one stratum, given as text."""
    ob = observer_view(spark, sf_dir, [*SAMPLE, "species", "tgt_mt", "exp_sp_ct"])
    fleet = fleet_view(spark, sf_dir, ["sector", "tgt_mt"])
    return round_measures(expand_to_fleet(ob, fleet, "sector", SPECIES, unit="exp_sp_ct", cleanup=False), ["sector"])


@register("sector_request")
def sector_request_by_group(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SAMPLE, "r_state", "species", "grouping", "tgt_mt", "dis_mt"])
    fleet = fleet_view(spark, sf_dir, [*SYG, "agency_code", "tgt_mt"])
    return sector_request(ob, fleet, ["ASIA", "EUROPE"], DOMAINS, group_col="grouping")


@register("boot_ratio")
def boot_ratio(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SY, *UNITS, "datatype", "species", "tgt_mt", "dis_mt"])
    out = bootstrap_ratio(ob, SY, DOMAINS, replicates=10_000, program="shore", **MD5)
    return round_measures(out, SY)


@register("boot_expand")
def boot_expand(spark, sf_dir):
    keys = ["year", "state", "season"]
    cols = ["sector", "year", "r_state", "rmonth", *UNITS, "datatype", "species", "spid_eqv", "catch_disposition",
            "exp_sp_ct", "tgt_mt"]
    ob = indicator_measure(
        derive_observer_strata(observer_view(spark, sf_dir, cols)), "promo_count", "exp_sp_ct", "PROMO",
        codes=["PROM"], whole=True,
    )
    fleet = derive_fleet_strata(fleet_view(spark, sf_dir, ["year", "agency_code", "landing_month", "tgt_mt"]))
    out = bootstrap_expand(ob, fleet, keys, ["PROMO"], unit="promo_count", replicates=10_000, program="shore", **MD5)
    return round_measures(out, keys)


@register("boot_expand_unobserved")
def boot_expand_unobserved(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SY, *UNITS, "datatype", "species", "tgt_mt", "dis_mt"])
    fleet = fleet_view(spark, sf_dir, [*SY, "tgt_mt"])
    out = bootstrap_expand(ob, fleet, SY, DOMAINS, replicates=10_000, program="shore", **MD5)
    return round_measures(out, SY)


@register("boot_pooled")
def boot_pooled(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SY, *UNITS, "datatype", "species", "tgt_mt", "dis_mt"])
    out = bootstrap_ratio(ob, "sector", DOMAINS, unit_strata=SY, replicates=10_000, program="shore", **MD5)
    return round_measures(out, ["sector"])


@register("boot_chunks")
def boot_chunks(spark, sf_dir):
    """Strata cut into chunks of seven vessels; the SQL knows no chunks."""
    ob = observer_view(spark, sf_dir, [*SY, *UNITS, "datatype", "species", "tgt_mt", "dis_mt"])
    out = bootstrap_ratio(ob, SY, DOMAINS, replicates=10_000, chunk_units=7, program="shore", **MD5)
    return round_measures(out, SY)


@register("boot_tree")
def boot_tree(spark, sf_dir):
    """Draws dealt to nodes of eight vessels, nodes cut into chunks of five; the SQL knows the tree only."""
    ob = observer_view(spark, sf_dir, [*SY, *UNITS, "datatype", "species", "tgt_mt", "dis_mt"])
    out = bootstrap_ratio(ob, SY, DOMAINS, replicates=10_000, node_units=8, chunk_units=5, program="shore", **MD5)
    return round_measures(out, SY)


@register("boot_forty")
def boot_forty_species(spark, sf_dir):
    """Forty species, of which ten never occur and the others in few vessels each."""
    ob = observer_view(spark, sf_dir, [*SY, *UNITS, "datatype", "species", "tgt_mt", "dis_mt"])
    ob = ob.withColumn("kind", F.concat_ws(" ", "species", "sector"))
    return round_measures(bootstrap_ratio(ob, "year", FORTY, domain_col="kind", replicates=1_000, program="shore", **MD5), ["year"])


@register("boot_pooled_expand")
def boot_pooled_expand(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SY, *UNITS, "datatype", "species", "tgt_mt", "dis_mt"])
    fleet = fleet_view(spark, sf_dir, ["sector", "tgt_mt"])
    out = bootstrap_expand(ob, fleet, "sector", DOMAINS, unit_strata=SY, program="shore", **MD5)
    return round_measures(out, ["sector"])


@register("boot_complete_domains")
def boot_complete_domains(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SY, *UNITS, "datatype", "species", "tgt_mt", "dis_mt"])
    fleet = fleet_view(spark, sf_dir, [*SY, "tgt_mt"])
    out = bootstrap_expand(ob, fleet, SY, DOMAINS, complete_domains=True, program="shore", **MD5)
    return round_measures(out, SY)


@register("boot_at_sea")
def boot_at_sea(spark, sf_dir):
    """At-sea conventions: processed weight as effort, all record classes, no trips."""
    ob = observer_view(spark, sf_dir, [*SY, *UNITS, "datatype", "species", "tgt_mt", "pwht_mt", "dis_mt"])
    at_sea = ob.withColumn("sector", F.when(F.col("sector") == "ASIA", "MOTHERSHIP").otherwise(F.col("sector")))
    out = bootstrap_ratio(at_sea, SY, DOMAINS, program="at_sea", **MD5)
    return round_measures(out, SY)


@register("boot_replicates")
def boot_replicate_ratios(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SY, "drvid", "datatype", "species", "tgt_mt", "dis_mt"])
    ob = ob.where(F.col("datatype") == "Analysis Data")
    return round_measures(boot_replicates(ob, SY, DOMAINS, replicates=10_000, **MD5), SY)


@register("unsampled_expansion")
def unsampled_expansion(spark, sf_dir):
    keys = ["year", "r_state"]
    cols = [*keys, *UNITS, "species", "datatype", "common_name", "ifq", "catch_disposition", "mt", "tgt_mt",
            "exp_sp_ct", "exp_sp_wt"]
    out = expand_unsampled(observer_view(spark, sf_dir, cols), keys, DOMAINS, POLICY)
    return round_measures(out, keys)


UNSAMPLED = ["year", "r_state", *UNITS, "species", "datatype", "common_name", "ifq", "catch_disposition", "mt", "tgt_mt",
             "exp_sp_ct", "exp_sp_wt"]


@register("unsampled_all_species")
def unsampled_all_species(spark, sf_dir):
    keys, policy = ["year", "r_state"], {s: ALWAYS if s == "SMALL" else EXCLUDE_IF_PRESENT for s in SPECIES}
    return round_measures(expand_unsampled(observer_view(spark, sf_dir, UNSAMPLED), keys, SPECIES, policy), keys)


@register("unsampled_ignore_missing")
def unsampled_ignore_missing(spark, sf_dir):
    """Missing values left out instead of making a sum missing."""
    keys = ["year", "r_state"]
    ob = observer_view(spark, sf_dir, UNSAMPLED)
    return round_measures(expand_unsampled(ob, keys, DOMAINS, POLICY, na_policy="ignore"), keys)


@register("ratio_se")
def ratio_standard_error(spark, sf_dir):
    cols = [*SYG, *UNITS, "tgt_mt", "dis_mt"]
    hauls = observer_view(spark, sf_dir, cols).groupBy(*SYG, *UNITS).agg(
        F.sum("dis_mt").alias("byc"), F.sum("tgt_mt").alias("expf")
    )
    means = hauls.groupBy(*SYG).agg(
        F.avg("byc").alias("mean_byc"),
        F.avg("expf").alias("mean_expf"),
        standard_error(F.col("byc")).alias("se_byc"),
        standard_error(F.col("expf")).alias("se_expf"),
    )
    se = ratio_se(F.col("mean_byc"), F.col("mean_expf"), F.col("se_byc"), F.col("se_expf"))
    return round_measures(means.withColumn("byc_se", se), SYG)


@register("fleet_effort")
def fleet_effort_totals(spark, sf_dir):
    fleet = fleet_view(spark, sf_dir, [*SYG, "tgt_mt"])
    both = null_safe_join(fleet_effort(fleet, SYG), fleet_effort(fleet, SYG, moments=True), SYG, "full")
    return round_measures(both, SYG)


@register("observed_effort")
def observed_effort_totals(spark, sf_dir):
    return round_measures(observed_effort(observer_view(spark, sf_dir, [*SAMPLE, "gfr_mt"]), SYG, "gfr_mt"), SYG)


@register("zero_filled_bycatch")
def zero_filled_bycatch_moments(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SY, *UNITS, "species", "dis_mt"])
    return round_measures(zero_filled_bycatch(ob, SY, [*DOMAINS, "NEVER SEEN"]), SY)


@register("vessel_rollup")
def vessel_sums(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SY, "drvid", "species", "gfr_mt", "dis_mt"])
    return round_measures(vessel_rollup(ob, SY, DOMAINS, "gfr_mt"), SY)


@register("vessel_rollup_forty")
def vessel_sums_of_forty(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SY, "drvid", "species", "gfr_mt", "dis_mt"])
    ob = ob.withColumn("kind", F.concat_ws(" ", "species", "sector"))
    return round_measures(vessel_rollup(ob, ["year"], FORTY, "gfr_mt", domain_col="kind"), ["year"])


@register("program_normalise")
def program_conventions(spark, sf_dir):
    cols = ["sector", "trip_id", "drvid", "datatype", "tgt_mt", "pwht_mt"]
    ob = observer_view(spark, sf_dir, cols)
    at_sea = ob.withColumn("sector", F.when(F.col("sector") == "ASIA", "MOTHERSHIP").otherwise(F.col("sector")))

    def summary(df, label):
        return df.groupBy("sector").agg(
            F.lit(label).alias("program"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count("trip_id").alias("n_with_trip"),
            F.sum("tgt_mt").alias("tgt_mt"),
        )

    parts = [summary(program_normalise(at_sea, "auto"), "at_sea"), summary(program_normalise(ob, "auto"), "shore")]
    return round_measures(union_domains(parts), ["sector"])


@register("clean_names")
def clean_column_names(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    messy = orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_custkey").toDF(
        "OrderKey", "Total Price ($)", "ORDER.Status", "% Priority", "orderKey"
    )
    return clean_names(messy)


@register("derive_strata")
def derived_strata(spark, sf_dir):
    ob = derive_observer_strata(observer_view(spark, sf_dir, ["r_state", "rmonth", "cs_gear", "tgt_mt"]))
    fleet = derive_fleet_strata(fleet_view(spark, sf_dir, ["agency_code", "landing_month", "tgt_mt"]))
    seen = ob.groupBy("state", "season", "cs_sector").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("tgt_mt").alias("tgt_mt")
    )
    landed = fleet.groupBy("state", "season").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("tgt_mt").alias("tgt_mt")
    )
    return round_measures(union_domains([seen, landed]), [])


@register("indicator_measure")
def indicator_measures(spark, sf_dir):
    cols = [*SY, "species", "spid_eqv", "catch_disposition", "exp_sp_wt"]
    ob = indicator_measure(
        observer_view(spark, sf_dir, cols), "whole_lb", "exp_sp_wt", DOMAINS, codes=["LARG"], whole=True
    )
    ob = indicator_measure(ob, "any_lb", "exp_sp_wt", "MEDIUM", disposition=None)
    return round_measures(ob.groupBy(*SY).agg(F.sum("whole_lb").alias("whole_lb"), F.sum("any_lb").alias("any_lb")), SY)


@register("clamp_bounds")
def clamped_bounds(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SAMPLE, "species", "tgt_mt", "dis_mt"])
    fleet = fleet_view(spark, sf_dir, [*SYG, "tgt_mt"])
    out = expand_to_fleet(ob, fleet, SYG, DOMAINS, cleanup=False).select(
        *SYG, "species", "total_byc", "est_byc_lower",
        clamp_lower(F.col("est_byc_lower"), F.col("total_byc")).alias("clamped"),
    )
    return round_measures(out, SYG)


@register("sector_filter")
def sector_selection(spark, sf_dir):
    ob = observer_view(spark, sf_dir, ["sector", "gear", "dis_mt"])
    kept = sector_filter(sector_filter(ob, keep=["ASIA", "EUROPE", "AFRICA"]), drop=["AFRICA"])
    out = kept.groupBy("sector", "gear").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("dis_mt").alias("dis_mt"))
    return round_measures(out, ["sector"])


@register("vessel_ticket_join")
def vessel_tickets(spark, sf_dir):
    cols = [*SY, "drvid", "datatype", "species", "gfr_mt", "dis_mt"]
    ob = observer_view(spark, sf_dir, cols).where(F.col("datatype") == "Analysis Data")
    fleet = fleet_view(spark, sf_dir, [*SY, "drvid", "gfr_mt"])
    return round_measures(vessel_ticket_join(ob, fleet, SY, "PROMO"), SY)


@register("vessel_ticket_matches")
def vessel_tickets_matched(spark, sf_dir):
    """Observed vessels with landings only; one vessel in three has none here."""
    ob = observer_view(spark, sf_dir, [*SY, "drvid", "datatype", "species", "gfr_mt", "dis_mt"]).where(F.col("datatype") == "Analysis Data")
    fleet = fleet_view(spark, sf_dir, [*SY, "drvid", "gfr_mt"]).where(F.col("drvid") % 3 != 0)
    return round_measures(vessel_ticket_join(ob, fleet, SY, "PROMO", matched_only=True), SY)


@register("nifq_haul_set")
def nifq_hauls(spark, sf_dir):
    cols = ["haul_id", "species", "datatype", "common_name", "ifq", "catch_disposition"]
    return nifq_haul_set(observer_view(spark, sf_dir, cols), DOMAINS, POLICY)


@register("failed_trips")
def failed_trip_set(spark, sf_dir):
    return failed_trips(observer_view(spark, sf_dir, ["trip_id", "datatype"]))


@register("sectors_with_species")
def sectors_with_species(spark, sf_dir):
    ob = observer_view(spark, sf_dir, ["sector", "gear", "common_name"])
    sectors = sectors_with_domain(ob, "Unsorted catch not sampled", domain_col="common_name")
    fleet = restrict_to_sectors(fleet_view(spark, sf_dir, ["sector", "tgt_mt"]), sectors)
    totals = fleet.groupBy("sector").agg(F.sum("tgt_mt").alias("tgt_mt"))
    return round_measures(null_safe_join(sectors, totals, ["sector"], "left"), ["sector"])


@register("strict_sum")
def strict_sums(spark, sf_dir):
    ob = observer_view(spark, sf_dir, ["year", "drvid", "ifq", "mt"])
    out = ob.groupBy("year", "drvid").agg(
        strict_sum(measure("mt"), F.col("ifq") == 0).alias("mt_not_ifq"), strict_sum(measure("mt")).alias("mt")
    )
    return round_measures(out, ["year"])


@register("standard_error")
def standard_errors(spark, sf_dir):
    hauls = observer_view(spark, sf_dir, [*SYG, *UNITS, "mt"]).groupBy(*SYG, *UNITS).agg(F.sum("mt").alias("haul_mt"))
    out = hauls.groupBy(*SYG).agg(
        F.avg("haul_mt").alias("mean_mt"), standard_error(F.col("haul_mt")).alias("se_mt")
    )
    return round_measures(out, SYG)


@register("sample_sizes")
def unit_counts(spark, sf_dir):
    return sample_sizes(observer_view(spark, sf_dir, [*SYG, *UNITS]), SYG)


@register("record_class_counts")
def record_classes(spark, sf_dir):
    return record_class_counts(observer_view(spark, sf_dir, ["datatype"]))


@register("small_cells")
def small_cell_flags(spark, sf_dir):
    keys = [*SYG, "state", "season"]
    cols = [*SYG, "r_state", "rmonth", *UNITS, "datatype", "tgt_mt"]
    effort = observed_effort(derive_observer_strata(observer_view(spark, sf_dir, cols)), keys)
    return flag_small_cells(effort).select(*keys, "n_obs_ves", "small_cell")


@register("key_quality")
def missing_keys(spark, sf_dir):
    return key_quality(observer_view(spark, sf_dir, UNITS))


@register("partition_total")
def stratum_totals_by_vessel(spark, sf_dir):
    return round_measures(partition_total(fleet_view(spark, sf_dir, [*SY, "drvid", "gfr_mt"]), SY), SY)


@register("union_domains")
def union_of_domains(spark, sf_dir):
    cols = [*SYG, *UNITS, "species", "catch_disposition", "datatype", "dis_mt", "tgt_mt"]
    ob = observer_view(spark, sf_dir, cols).where(F.col("datatype") == "Analysis Data")
    parts = [
        indicator_measure(ob, "my_dis", "dis_mt", d).withColumn("my_species", F.lit(d)) for d in DOMAINS
    ]
    hauls = union_domains(parts).groupBy("my_species", *SYG, *UNITS).agg(
        F.sum("my_dis").alias("my_dis"), F.sum("tgt_mt").alias("tgt_mt")
    )
    out = hauls.groupBy("my_species", *SYG).agg(
        F.sum("my_dis").alias("total_byc"), F.sum("tgt_mt").alias("total_expf"), F.avg("my_dis").alias("mean_byc")
    )
    out = out.withColumn("byc_ratio", divide(F.col("total_byc"), F.col("total_expf")))
    return round_measures(out.withColumnRenamed("my_species", "species"), SYG)


@register("distinct_units")
def sampling_units(spark, sf_dir):
    return distinct_units(observer_view(spark, sf_dir, [*SYG, *UNITS]), SYG)


@register("round_and_percent")
def rounding_and_percent(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SYG, "mt", "dis_mt"])
    sums = ob.groupBy(*SYG).agg(F.sum("mt").alias("mt"), F.sum("dis_mt").alias("dis_mt"))
    share = percent(F.col("dis_mt"), F.col("mt"))
    return sums.select(*SYG, *[stable_round(share, d).alias(f"pct_{d}") for d in (1, 2, 3, 5, 6)])


@register("label_repair")
def repaired_labels(spark, sf_dir):
    ob = observer_view(spark, sf_dir, ["grouping", "dis_mt"])
    out = ob.groupBy(repair_label(F.col("grouping")).alias("grouping")).agg(F.sum("dis_mt").alias("dis_mt"))
    return round_measures(out, [])


@register("ticket_match_rate")
def ticket_matches(spark, sf_dir):
    ob = observer_view(spark, sf_dir, ["fish_tickets"])
    return round_measures(ticket_match_rate(ob, fleet_view(spark, sf_dir, ["ftid"])), [])


@register("coverage")
def effort_coverage(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SAMPLE, "tgt_mt"])
    return round_measures(coverage(ob, fleet_view(spark, sf_dir, [*SYG, "tgt_mt"]), SYG), SYG)


@register("unobserved_strata")
def unobserved_strata_audit(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SAMPLE, "species", "tgt_mt", "dis_mt"])
    fleet = fleet_view(spark, sf_dir, [*SYG, "tgt_mt"])
    result = coverage(ob, fleet, SYG)
    sizes = observed_effort(ob, SYG).select(*SYG, "n_obs_ves")
    return unobserved_strata(null_safe_join(result, sizes, SYG, "left"), ob, SYG)


@register("reconcile")
def reconciled_ratios(spark, sf_dir, mismatches_only=False):
    """The ratio over hauls against the ratio over vessels, which keeps records without haul."""
    ob = observer_view(spark, sf_dir, [*SYG, *UNITS, "datatype", "species", "tgt_mt", "dis_mt"])
    by_haul = ratio_table(ob, SYG, DOMAINS, analysis_only=True)
    vessels = vessel_rollup(ob.where(F.col("datatype") == "Analysis Data"), SYG, DOMAINS)
    by_vessel = (
        vessels.where(F.col("ves_expf") > 0)
        .groupBy(*SYG, "species")
        .agg(F.sum("ves_byc").alias("total_byc"), F.sum("ves_expf").alias("total_expf"))
        .withColumn("byc_ratio", divide(F.col("total_byc"), F.col("total_expf")))
    )
    out = reconcile(by_haul, by_vessel, [*SYG, "species"], ["total_byc", "byc_ratio"], tolerance=1e-4, mismatches_only=mismatches_only)
    return round_measures(out, SYG)


@register("reconcile_mismatches")
def reconciled_mismatches(spark, sf_dir):
    return reconciled_ratios(spark, sf_dir, mismatches_only=True)


@register("cell_range")
def cell_range_of_vessels(spark, sf_dir):
    keys = [*SYG, "state", "season"]
    cols = [*SYG, "r_state", "rmonth", *UNITS, "datatype", "tgt_mt"]
    ob = derive_observer_strata(observer_view(spark, sf_dir, cols))
    return cell_range(observed_effort(ob, keys))


@register("row_counts")
def row_counts_of_strata(spark, sf_dir):
    ob = observer_view(spark, sf_dir, [*SAMPLE, "tgt_mt"])
    return row_counts(observed_effort(ob, SYG), fleet_effort(fleet_view(spark, sf_dir, [*SYG, "tgt_mt"]), SYG))


@register("component_totals")
def component_totals(spark, sf_dir):
    keys = ["year", "r_state"]
    cols = [*keys, *UNITS, "species", "datatype", "common_name", "ifq", "catch_disposition", "mt", "tgt_mt",
            "exp_sp_ct", "exp_sp_wt"]
    est = expand_unsampled(observer_view(spark, sf_dir, cols), keys, DOMAINS, POLICY)
    columns = [f"est_{c}_ct" for c in ("nifq", "zmis", "unst", "fail")]
    out = est.select(*keys, "bycsp", total_of_components(columns).alias("est_ct"), F.col("obs_byc_ct"))
    return round_measures(zero_fill(out, keys), keys)


@register("numeric_year")
def numeric_years(spark, sf_dir):
    ob = drop_empty_disposition(observer_view(spark, sf_dir, ["year", "catch_disposition", "mt"]))
    texts = ob.withColumn("year", F.concat(F.lit(" "), F.col("year").cast("string")))
    out = numeric_year(texts).groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("mt").alias("mt"))
    return round_measures(out, ["year"])


@register("result_round_trip")
def result_round_trip(spark, sf_dir):
    """Totals written to the shared folder and read back through the reader."""
    fleet = fleet_view(spark, sf_dir, [*SYG, "tgt_mt"])
    path = f"{shared_folder(spark)}/fleetratio-round-trip-{uuid.uuid4().hex}"
    write_result(fleet_effort(fleet, SYG), path)
    return round_measures(read_table(spark, path, required=[*SYG, "fleet_expf"]), SYG)


@register("fleet_of_one_year")
def fleet_of_one_year(spark, sf_dir):
    """Landing lines as delivered, with untidy names, stored by year; one year of them read back through the reader."""
    lines = fleet_view(spark, sf_dir, [*SYG, "drvid", "tgt_mt"]).toDF("Sector", "Year", "GEAR", "DRVID", "Tgt MT")
    path = f"{shared_folder(spark)}/fleetratio-by-year-{uuid.uuid4().hex}"
    write_partitioned(lines, path, "Year", files_per_value=2)
    fleet = read_fleet(spark, path, required=[*SYG, "drvid", "tgt_mt"], tidy_names=True)
    return round_measures(fleet_effort(fleet.where(F.col("year") == 1997), SYG), SYG)


@register("ratio_from_files")
def ratio_from_files(spark, sf_dir):
    """Catch records as delivered, with untidy names, stored by year; three years of them through the reader."""
    records = observer_view(spark, sf_dir, [*SAMPLE, "species", "tgt_mt", "dis_mt"])
    untidy = records.toDF("Sector", "Year", "GEAR", "HAUL_ID", "TRIP_ID", "DRVID", "Datatype", "Species", "Tgt MT", "DIS.mt")
    path = f"{shared_folder(spark)}/fleetratio-records-{uuid.uuid4().hex}"
    write_partitioned(untidy, path, "Year")
    ob = read_observer(spark, path, tidy_names=True).where(F.col("year").between(1995, 1997))
    return round_measures(ratio_table(ob, SYG, DOMAINS), SYG)
