"""Expansion of ratio tables to the whole fleet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean_names, column_list, domain_list, require_columns
from ..functions.nulls import divide, measure, n_distinct, null_safe_join, strict_sum, sum_or_zero
from ..functions.stats import Z_95, clamp_lower, percent, stable_round, standard_error
from .moments import UNIT_COLS, by_unit, fleet_effort
from .ratio import ratio_table, with_ratio


def spread_domains(df: DataFrame, domains: Sequence[str] | str, domain_col: str = "species") -> DataFrame:
    """One row per row of ``df`` and domain, by exploding a literal array: no join involved."""
    names = domain_list(domains)
    return df.withColumn(domain_col, F.explode(F.array(*[F.lit(d) for d in names])))


def repair_label(label):
    """Put the degree sign back where a text export wrote ``<b0>``."""
    return F.regexp_replace(label, "<b0>", "°")


def add_expansion(df: DataFrame) -> DataFrame:
    """Coverage and expanded estimates from ratio columns and ``fleet_expf``."""
    fleet = F.col("fleet_expf")
    return df.withColumns(
        {
            "pct_cvg": percent(F.col("total_expf"), fleet, 2),
            "est_byc": F.col("byc_ratio") * fleet,
            "est_byc_lower": F.col("byc_ratio_lower") * fleet,
            "est_byc_upper": F.col("byc_ratio_upper") * fleet,
        }
    )


def clean_report(
    df: DataFrame, strata: Sequence[str] | str, domain_col: str = "species", group_col: str | None = None
) -> DataFrame:
    """Report form of an expanded table: selected columns, counts zero-filled, rounded, bound clamped.

    The order matters: the lower bound is compared after rounding.
    """
    rounded = {
        c: stable_round(F.col(c), 3)
        for c in ("obs_expf", "fleet_expf", "obs_byc", "est_byc", "est_byc_lower", "est_byc_upper")
    }
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("pct_cvg", "n_obs_ves", "n_obs_trips", "n_obs_hauls")}
    return (
        df.select(
            domain_col,
            *([group_col] if group_col else []),
            *column_list(strata),
            F.col("total_byc").alias("obs_byc"),
            F.col("total_expf").alias("obs_expf"),
            "fleet_expf",
            "pct_cvg",
            "n_obs_ves",
            "n_obs_trips",
            "n_obs_hauls",
            "n_hauls_byc",
            "pct_hauls_byc",
            "byc_ratio",
            "est_byc",
            "est_byc_lower",
            "est_byc_upper",
        )
        .withColumns({**filled, **rounded, "byc_ratio": stable_round(F.col("byc_ratio"), 5)})
        .withColumn("est_byc_lower", clamp_lower(F.col("est_byc_lower"), F.col("obs_byc")))
    )


def expand_to_fleet(
    ob: DataFrame,
    fleet: DataFrame,
    strata: Sequence[str] | str,
    domains: Sequence[str] | str,
    effort: str = "tgt_mt",
    unit: str = "dis_mt",
    domain_col: str = "species",
    group_col: str | None = None,
    cleanup: bool = True,
    unit_cols: Sequence[str] = UNIT_COLS,
    analysis_only: bool = False,
    z: float = Z_95,
) -> DataFrame:
    """Estimated fleet bycatch per stratum and domain with bounds, coverage and sample sizes.

    A fleet stratum without sample keeps one row per domain; its group is NULL. The full join
    meets two tables of one row per stratum and domain.
    """
    strata = column_list(strata)
    ratios = ratio_table(ob, strata, domains, effort, unit, domain_col, group_col, unit_cols, analysis_only, z)
    totals = spread_domains(fleet_effort(clean_names(fleet), strata, effort), domains, domain_col)
    out = add_expansion(null_safe_join(totals, ratios, [*strata, domain_col], "full"))
    if group_col:
        out = out.withColumn(group_col, repair_label(F.col(group_col)))
    return clean_report(out, strata, domain_col, group_col) if cleanup else out


def expand_single(
    ob: DataFrame,
    fleet: DataFrame,
    strata: Sequence[str] | str,
    effort: str,
    bycatch: str,
    unit_cols: Sequence[str] = UNIT_COLS,
    z: float = Z_95,
) -> DataFrame:
    """Ratio estimate of one bycatch column with fleet expansion and a small-cell flag.

    No record is filtered here: the caller chooses the sample. Missing totals and moments count
    as zero before the ratio is taken.
    """
    strata = column_list(strata)
    haul, trip, vessel = unit_cols
    require_columns(ob, [*strata, *unit_cols, effort, bycatch], "observer table")
    require_columns(fleet, [*strata, effort], "fleet table")
    records = by_unit(
        ob.select(*strata, *unit_cols, measure(bycatch).alias("__bycatch"), measure(effort).alias("__effort")), [*strata, *unit_cols]
    )
    units = records.groupBy(*strata, *unit_cols).agg(
        strict_sum(F.col("__bycatch")).alias("__byc"), sum_or_zero(F.col("__effort")).alias("__expf")
    )
    byc, expf = F.col("__byc"), F.col("__expf")
    complete = F.count(F.lit(1)) == F.count(byc)
    observed = units.groupBy(*strata).agg(
        strict_sum(byc).alias("total_byc"),
        F.when(complete, F.avg(byc)).alias("mean_byc"),
        F.when(complete, standard_error(byc)).alias("se_byc"),
        F.sum(expf).alias("total_expf"),
        F.avg(expf).alias("mean_expf"),
        standard_error(expf).alias("se_expf"),
        n_distinct(F.col(vessel)).alias("n_obs_ves"),
        n_distinct(F.col(trip)).alias("n_obs_trips"),
        n_distinct(F.col(haul)).alias("n_obs_hauls"),
    )
    both = null_safe_join(observed, fleet_effort(fleet, strata, effort, moments=True), strata, "full")
    measures = [c for c in both.columns if c not in strata]
    ratio = with_ratio(both.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in measures}), z)
    total = F.col("total_ft_expf")
    lower, upper = (F.coalesce(F.col(f"byc_ratio_{side}") * total, F.lit(0.0)) for side in ("lower", "upper"))
    return ratio.withColumns(
        {
            "pct_cvg": divide(F.col("total_expf"), total) * 100,
            "expand_byc": F.col("byc_ratio") * total,
            "expand_byc_lower": clamp_lower(lower, F.col("total_byc")),
            "expand_byc_upper": upper,
            "small_cell": F.col("n_obs_ves").between(1, 2),
        }
    )
