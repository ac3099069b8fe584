"""Ratio tables: observed bycatch per unit of observed effort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import column_list
from ..functions.nulls import divide
from ..functions.stats import Z_95, percent, ratio_se
from .moments import UNIT_COLS, stratum_domain_moments


def with_ratio(df: DataFrame, z: float = Z_95) -> DataFrame:
    """Add ratio, delta-method standard error and bounds from the moment columns."""
    out = df.withColumn("byc_ratio", divide(F.col("total_byc"), F.col("total_expf")))
    out = out.withColumn(
        "byc_se", ratio_se(F.col("mean_byc"), F.col("mean_expf"), F.col("se_byc"), F.col("se_expf"))
    )
    return out.withColumns(
        {
            "byc_ratio_lower": F.col("byc_ratio") - z * F.col("byc_se"),
            "byc_ratio_upper": F.col("byc_ratio") + z * F.col("byc_se"),
        }
    )


def ratio_table(
    ob: DataFrame,
    strata: Sequence[str] | str = ("sector", "gear", "year"),
    domains: Sequence[str] | str = (),
    effort: str = "tgt_mt",
    unit: str = "dis_mt",
    domain_col: str = "species",
    group_col: str | None = None,
    unit_cols: Sequence[str] = UNIT_COLS,
    analysis_only: bool = False,
    z: float = Z_95,
) -> DataFrame:
    """Bycatch ratio per stratum and domain, by management group where ``group_col`` is given.

    Effort counts only sampled records; bycatch counts every record with a haul, unless
    ``analysis_only`` restricts both. Records without a haul id are left out.
    """
    strata = column_list(strata)
    table = stratum_domain_moments(
        ob, strata, domains, effort, unit, domain_col, group_col, unit_cols, analysis_only
    )
    return with_ratio(table, z).withColumn(
        "pct_hauls_byc", percent(F.col("n_hauls_byc"), F.col("n_obs_hauls"), 2)
    )
