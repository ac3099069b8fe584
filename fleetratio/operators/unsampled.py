"""Expansion of observed discards to unsampled and failed records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import column_list, domain_list, require_columns
from ..functions.nulls import is_true, measure, null_safe_join, strict_sum, sum_or_zero
from ..functions.stats import LB_PER_MT, expand_component, percent
from .moments import ANALYSIS, by_unit

# Record classes, names and codes of the catch records.
UNSAMPLED_IFQ = "Unsampled IFQ"
UNSAMPLED_ZMIS = "Unsampled ZMIS"
FAILED = "Failed Data"
NON_IFQ = "Non-IFQ Fish Species"
MISC_MIXED = "Misc Mixed Species"
UNSORTED = "Unsorted catch not sampled"
DISCARDED = "D"

EXCLUDE_IF_PRESENT = "exclude_if_present"
ALWAYS = "always"

# Which hauls with unsampled non-IFQ catch are expanded, by species.
DEFAULT_POLICY = {
    "Chinook (King) Salmon": EXCLUDE_IF_PRESENT,
    "Chum (Dog) Salmon": EXCLUDE_IF_PRESENT,
    "Coho (Silver) Salmon": EXCLUDE_IF_PRESENT,
    "Pink (Humpback) Salmon": EXCLUDE_IF_PRESENT,
    "Steelhead (Rainbow Trout)": EXCLUDE_IF_PRESENT,
    "Sockeye (Red) Salmon": EXCLUDE_IF_PRESENT,
    "Salmon Unid": EXCLUDE_IF_PRESENT,
    "Green Sturgeon": EXCLUDE_IF_PRESENT,
    "Eulachon": ALWAYS,
}

COMPONENTS = ("nifq", "zmis", "unst", "fail")


def _is(name: str, value: str) -> Column:
    return F.col(name) == value


def _nifq_record() -> Column:
    """A discarded record of unsampled non-IFQ catch; it marks its whole haul."""
    non_ifq = _is("common_name", NON_IFQ) | (F.col("ifq") == 0)
    return _is("datatype", UNSAMPLED_IFQ) & non_ifq & _is("catch_disposition", DISCARDED)


def _possible(name: str, *values: str) -> Column:
    """Rows for which ``name`` is one of the values or missing; a form the scan can evaluate."""
    return F.col(name).isin(list(values)) | F.col(name).isNull()


def _check_policy(domains: Sequence[str], policy: Mapping[str, str]) -> None:
    unknown = [d for d in domains if policy.get(d) not in (EXCLUDE_IF_PRESENT, ALWAYS)]
    if unknown:
        raise ValueError(f"no haul policy for: {', '.join(unknown)}")


def nifq_haul_domains(
    ob: DataFrame, domains: Sequence[str] | str, domain_col: str = "species", haul_col: str = "haul_id"
) -> DataFrame:
    """Hauls with unsampled non-IFQ discards, and which of the domains they discarded by name.

    Only the marking records and the discards of the domains leave the scan; the set collected
    per haul holds at most one entry per domain.
    """
    domains = domain_list(domains)
    marks = _nifq_record()
    named = F.col(domain_col).isin(domains) & _is("catch_disposition", DISCARDED)
    return (
        ob.where(marks | named)
        .groupBy(haul_col)
        .agg(
            F.bool_or(is_true(marks)).alias("nifq_haul"),
            F.array_sort(F.collect_set(F.when(named, F.col(domain_col)))).alias("present"),
        )
        .where("nifq_haul")
        .drop("nifq_haul")
    )


def nifq_haul_set(
    ob: DataFrame,
    domains: Sequence[str] | str,
    policy: Mapping[str, str] = DEFAULT_POLICY,
    domain_col: str = "species",
    haul_col: str = "haul_id",
) -> DataFrame:
    """The hauls to be expanded for each domain: (haul, domain) rows."""
    domains = domain_list(domains)
    _check_policy(domains, policy)
    always = F.array(*[F.lit(d) for d in domains if policy[d] == ALWAYS]).cast("array<string>")
    listed = F.array(*[F.lit(d) for d in domains if policy[d] != ALWAYS]).cast("array<string>")
    hauls = nifq_haul_domains(ob, domains, domain_col, haul_col)
    chosen = F.concat(F.array_except(listed, F.col("present")), always)
    return hauls.select(haul_col, F.explode(chosen).alias(domain_col))


def failed_trips(ob: DataFrame, trip_col: str = "trip_id") -> DataFrame:
    """Distinct trips with failed data; trips without id form one entry."""
    return ob.where(_is("datatype", FAILED)).select(trip_col).distinct()


def _total(value: Column, cond: Column, strict: bool) -> Column:
    return strict_sum(value, cond) if strict else sum_or_zero(F.when(cond, value))


def _again(name: str, strict: bool) -> Column:
    """Sum of sums: one that is unknown makes a strict sum unknown."""
    return strict_sum(F.col(name)) if strict else sum_or_zero(F.col(name))


def _seen() -> Column:
    """Records that count as observed; unknown where class or name leave it open."""
    return _is("datatype", ANALYSIS) | (_is("datatype", UNSAMPLED_IFQ) & (F.col("common_name") != NON_IFQ))


SUMS = ("nifq_denom", "zmis_denom", "zmis_expf", "unst_denom", "unst_expf", "fail_denom")
KNOWN_SUMS = ("obs_tgt_mt", "unobs_tgt_mt")
HAUL, TRIP, VESSEL = "haul", "trip", "vessel"
# Tasks that the records of one vessel are dealt to, at most.
VESSEL_PARTS = 8


def _addend(value: Column, cond: Column, strict: bool) -> Column:
    """What a record adds to a sum: nothing where ``cond`` does not hold, a missing value where a strict sum becomes unknown."""
    if not strict:
        return F.coalesce(F.when(cond, value), F.lit(0.0))
    return F.when(cond.isNull(), F.lit(None).cast("double")).when(cond, value).otherwise(F.lit(0.0))


def _record_values(ob, strata, unit_cols, strict) -> DataFrame:
    """What each record adds to the sums and flags that do not depend on a domain, dealt to tasks by vessel and haul.

    The records of a haul meet in one task and those of a vessel in few, where they are combined before they move on.
    """
    haul, _, vessel = unit_cols
    analysis, discarded = _is("datatype", ANALYSIS), _is("catch_disposition", DISCARDED)
    zmis = _is("datatype", UNSAMPLED_ZMIS) & discarded
    nifq = _is("datatype", UNSAMPLED_IFQ) & _is("common_name", NON_IFQ) & discarded
    mt, tgt = measure("mt"), measure("tgt_mt")
    values = {
        "nifq_denom": _addend(mt, (F.col("ifq") == 0) & analysis & discarded, strict),
        "zmis_denom": _addend(mt, analysis & discarded, strict),
        "zmis_expf": _addend(mt, zmis & _is("common_name", MISC_MIXED), strict),
        "unst_denom": _addend(mt, analysis, strict),
        "unst_expf": _addend(mt, zmis & _is("common_name", UNSORTED), strict),
        "fail_denom": _addend(tgt, analysis, strict),
        "obs_tgt_mt": _addend(tgt, _seen(), False),
        "unobs_tgt_mt": _addend(tgt, ~_seen(), False),
        "__nifq": _addend(mt, nifq, strict),
        "__tgt": _addend(tgt, F.lit(True), strict),
        "__seen": is_true(_seen()),
        "__unseen": is_true(~_seen()),
        "__unknown": _seen().isNull(),
    }
    records = ob.select(*strata, *unit_cols, *[expr.alias(name) for name, expr in values.items()])
    return by_unit(records, [F.col(vessel), F.pmod(F.xxhash64(haul), F.lit(VESSEL_PARTS))])


def _by_id(records, strata, unit_cols, strict) -> DataFrame:
    """One row per stratum and haul, per stratum and trip, per stratum and vessel, from the same records.

    A haul carries its unsampled non-IFQ catch, a trip its target catch, a vessel the sums of the stratum: three kinds
    of rows in one aggregation instead of one aggregation of the records for each kind. Sums of another kind stay NULL.
    A record without target catch has no row for its trip, as it adds nothing there.
    """
    haul, trip, vessel = unit_cols
    sums = [*SUMS, *KNOWN_SUMS, "__nifq", "__tgt"]
    flags = ["__seen", "__unseen", "__unknown"]

    def row(kind: str, id_col: str, kept: Sequence[str]) -> Column:
        values = [(F.col(c) if c in kept else F.lit(None).cast("double")).alias(c) for c in sums]
        return F.struct(F.lit(kind).alias("__kind"), F.col(id_col).cast("string").alias("__id"), *values, *flags)

    always = [row(HAUL, haul, ["__nifq"]), row(VESSEL, vessel, [*SUMS, *KNOWN_SUMS])]
    rows = F.when(F.col("__tgt") == 0, F.array(*always)).otherwise(F.array(*always, row(TRIP, trip, ["__tgt"])))
    return (
        records.select(*strata, F.inline(rows))
        .groupBy(*strata, "__kind", "__id")
        .agg(
            *[_again(c, strict and c not in KNOWN_SUMS).alias(c) for c in sums],
            *[F.bool_or(c).alias(c) for c in flags],
        )
    )


def _marks(ob, domains, domain_col, haul_col, trip_col) -> DataFrame:
    """The hauls to be expanded, with the domains they discarded by name, and the failed trips."""
    hauls = nifq_haul_domains(ob, domains, domain_col, haul_col)
    trips = failed_trips(ob, trip_col)
    none = F.array().cast("array<string>")
    return hauls.select(F.lit(HAUL).alias("__kind"), F.col(haul_col).cast("string").alias("__id"), "present").unionByName(
        trips.select(F.lit(TRIP).alias("__kind"), F.col(trip_col).cast("string").alias("__id"), none.alias("present"))
    ).withColumn("__marked", F.lit(True))


def _free_sums(by_id, marks, strata, strict) -> DataFrame:
    """Sums by stratum (``__domain`` NULL, struct ``__all``) and by stratum and domain (struct ``__nifq_sum``).

    ``__nifq_sum`` is (weight, unknown hauls, hauls) of the marked hauls: all of them in the NULL group, those
    that discarded the domain by name in its group. A list of domains costs no more than its hauls have.
    """
    # few hauls and trips are marked: the many rows are not sorted to meet them
    joined = null_safe_join(by_id, marks.hint("shuffle_hash"), ["__kind", "__id"], "left")
    alone = F.array(F.lit(None).cast("string"))
    groups = F.when(F.col("present").isNull(), alone).otherwise(F.concat(alone, "present"))
    rows = joined.withColumn("__domain", F.explode(groups))

    every = F.col("__domain").isNull()
    haul, trip, vessel = (_is("__kind", k) for k in (HAUL, TRIP, VESSEL))
    marked = F.coalesce("__marked", F.lit(False))

    def count(kind: Column, flag: str) -> Column:
        # A record of unknown class adds the missing value once to each count.
        missing = F.bool_or(F.col("__unknown")) | F.bool_or(kind & F.col(flag) & F.col("__id").isNull())
        return F.count_if(every & kind & F.col(flag) & F.col("__id").isNotNull()) + missing.cast("long")

    nifq = F.when(haul & marked, F.col("__nifq"))
    return rows.groupBy(*strata, "__domain").agg(
        F.struct(
            *[_total(F.col(c), vessel & every, strict).alias(c) for c in SUMS],
            *[sum_or_zero(F.when(vessel & every, F.col(c))).alias(c) for c in KNOWN_SUMS],
            _total(F.col("__tgt"), trip & marked, strict).alias("fail_expf"),
            count(haul, "__seen").alias("obs_hauls"),
            count(vessel, "__seen").alias("n_obs_ves"),
            count(haul, "__unseen").alias("unobs_hauls"),
        ).alias("__all"),
        F.struct(
            sum_or_zero(nifq).alias("mt"),
            F.count_if(haul & marked & F.col("__nifq").isNull()).alias("unknown"),
            F.count_if(haul & marked).alias("n"),
        ).alias("__nifq_sum"),
    )


def _domain_sums(ob, strata, domains, domain_col, strict) -> DataFrame:
    """Discarded count and weight (struct ``__own_sum``) of the sampled records by stratum and domain.

    Only records of the domains leave the scan, and those whose class, disposition or domain is
    missing: they make a strict sum unknown, without a domain that of every domain.
    """
    analysis, discarded = _is("datatype", ANALYSIS), _is("catch_disposition", DISCARDED)
    own = analysis & discarded & F.when(F.col(domain_col).isNotNull(), True)
    count, weight = measure("exp_sp_ct"), measure("exp_sp_wt") / LB_PER_MT
    listed = F.col(domain_col).isin(list(domains))
    if strict:
        wanted = _possible("datatype", ANALYSIS) & _possible("catch_disposition", DISCARDED) & (listed | F.col(domain_col).isNull())
    else:
        wanted = analysis & discarded & listed
    return ob.where(wanted).groupBy(*strata, F.col(domain_col).alias("__domain")).agg(
        F.struct(_total(count, own, strict).alias("ct"), _total(weight, own, strict).alias("wt")).alias("__own_sum")
    )


def _stratum_parts(free: DataFrame, own: DataFrame, strata) -> DataFrame:
    """One row per stratum: its sums as columns, those by domain as maps, from one aggregation of both tables."""
    named = F.col("__domain").isNotNull()

    def by_name(c: str) -> Column:
        entry = F.struct("__domain", c)
        return F.map_from_entries(F.collect_list(F.when(named & F.col(c).isNotNull(), entry)))

    parts = free.unionByName(own, allowMissingColumns=True).groupBy(*strata).agg(
        F.max(F.when(~named, F.col("__all"))).alias("__all"),
        F.max(F.when(~named, F.col("__nifq_sum"))).alias("__nifq_all"),
        by_name("__nifq_sum").alias("__nifq_present"),
        by_name("__own_sum").alias("__own"),
        F.coalesce(F.bool_or(~named & F.col("__own_sum").isNotNull() & F.col("__own_sum.ct").isNull()), F.lit(False)).alias("__blurred"),
    )
    return parts.select(*strata, "__all.*", "__nifq_all", "__nifq_present", "__own", "__blurred")


def _by_domain(parts: DataFrame, domains, policy, strict: bool) -> DataFrame:
    """One row per stratum and domain, with the domain's sums from the stratum's maps."""
    kinds = F.array(*[F.struct(F.lit(d).alias("bycsp"), F.lit(policy[d] == ALWAYS).alias("__always")) for d in domains])
    long = parts.select("*", F.inline(kinds))
    name = F.col("bycsp")
    own, present = F.try_element_at("__own", name), F.try_element_at("__nifq_present", name)
    everything, zero = F.col("__nifq_all"), F.lit(0.0)

    def left(field: str) -> Column:
        taken = F.coalesce(F.when(~F.col("__always"), present[field]), F.lit(0))
        return F.coalesce(everything[field], F.lit(0)) - taken

    nifq = F.when(left("n") > 0, left("mt")).otherwise(zero)
    sums = {u: F.when(own.isNull(), zero).otherwise(own[u]) for u in ("ct", "wt")}
    if strict:
        nifq = F.when(left("unknown") == 0, nifq)
        sums = {u: F.when(~F.col("__blurred"), c) for u, c in sums.items()}
    return long.withColumns({"__ct": sums["ct"], "__wt": sums["wt"], "nifq_expf": nifq})


def expand_unsampled(
    ob: DataFrame,
    strata: Sequence[str] | str,
    domains: Sequence[str] | str,
    policy: Mapping[str, str] = DEFAULT_POLICY,
    domain_col: str = "species",
    unit_cols: Sequence[str] = ("haul_id", "trip_id", "drvid"),
    na_policy: str = "strict",
    observed_weight_from_counts: bool = False,
) -> DataFrame:
    """Estimated discards of unsampled and failed records in four components.

    Domain-free sums are taken once: what a record adds to its haul, its trip and its vessel travels as three
    kinds of rows through one aggregation; the sums of the domains are rows, so a long list costs no more per record than a short one. ``na_policy='ignore'`` leaves missing values out instead
    of letting them make a sum missing. ``observed_weight_from_counts`` takes the observed weight
    from the counts, as older reports did.
    """
    strata, domains = column_list(strata), domain_list(domains)
    _check_policy(domains, policy)
    if na_policy not in ("strict", "ignore"):
        raise ValueError("na_policy is 'strict' or 'ignore'")
    strict = na_policy == "strict"
    haul, trip, _ = unit_cols
    require_columns(
        ob,
        [*strata, *unit_cols, domain_col, "datatype", "common_name", "ifq", "catch_disposition", "mt", "tgt_mt",
         "exp_sp_ct", "exp_sp_wt"],
        "observer table",
    )
    by_id = _by_id(_record_values(ob, strata, unit_cols, strict), strata, unit_cols, strict)
    free = _free_sums(by_id, _marks(ob, domains, domain_col, haul, trip), strata, strict)
    parts = _stratum_parts(free, _domain_sums(ob, strata, domains, domain_col, strict), strata)
    long = _by_domain(parts, domains, policy, strict)
    for c in COMPONENTS:
        long = long.withColumns({f"{c}_num_ct": F.col("__ct"), f"{c}_num_wt": F.col("__wt")})
    estimates = {
        f"est_{c}_{u}": expand_component(F.col(f"{c}_num_{u}"), F.col(f"{c}_denom"), F.col(f"{c}_expf"))
        for c in COMPONENTS
        for u in ("ct", "wt")
    }
    out = long.withColumns(estimates)
    out = out.withColumns(
        {
            f"est_unsamp_{u}": sum((F.col(f"est_{c}_{u}") for c in COMPONENTS[1:]), F.col(f"est_nifq_{u}"))
            for u in ("ct", "wt")
        }
    )
    all_tgt = F.col("obs_tgt_mt") + F.col("unobs_tgt_mt")
    out = out.withColumns(
        {
            "obs_byc_ct": F.col("__ct"),
            "obs_byc_wt": F.col("__ct") if observed_weight_from_counts else F.col("__wt"),
            "total_tgt_mt": all_tgt,
            "pct_tgt_obs": percent(F.col("obs_tgt_mt"), all_tgt, 1),
        }
    )
    out = out.withColumns({f"total_byc_{u}": F.col(f"obs_byc_{u}") + F.col(f"est_unsamp_{u}") for u in ("ct", "wt")})
    ordered = [f"{c}_{part}" for c in COMPONENTS for part in ("num_ct", "num_wt", "denom", "expf")]
    return out.select(
        *strata, "bycsp", *ordered, *estimates, "est_unsamp_ct", "est_unsamp_wt",
        "obs_tgt_mt", "obs_hauls", "obs_byc_ct", "obs_byc_wt", "n_obs_ves", "unobs_tgt_mt", "unobs_hauls",
        "pct_tgt_obs", "total_tgt_mt", "total_byc_ct", "total_byc_wt",
    )
