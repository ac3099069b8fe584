"""Whole data requests, from the two tables to a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.expand import expand_to_fleet
from ..operators.prepare import (
    derive_fleet_strata,
    derive_observer_strata,
    restrict_to_sectors,
    sector_filter,
    sectors_with_domain,
)


def species_request(
    ob: DataFrame,
    fleet: DataFrame,
    species: str,
    strata: Sequence[str] = ("year", "gear", "sector", "state"),
    drop_sectors: Sequence[str] = (),
    effort: str = "tgt_mt",
    unit: str = "dis_mt",
) -> DataFrame:
    """Expanded discards of one species in the sectors that ever caught it.

    With the sector among the strata the report is restricted, a row per stratum; else the records are.
    """
    sectors = sectors_with_domain(ob, species)
    strata, late = list(strata), "sector" in strata

    def prepared(df: DataFrame) -> DataFrame:
        kept = sector_filter(df, drop=list(drop_sectors))
        return kept if late else restrict_to_sectors(kept, sectors)

    report = expand_to_fleet(
        derive_observer_strata(prepared(ob)),
        derive_fleet_strata(prepared(fleet)),
        strata,
        [species],
        effort,
        unit,
    )
    return restrict_to_sectors(report, sectors) if late else report


def sector_request(
    ob: DataFrame,
    fleet: DataFrame,
    sectors: Sequence[str],
    species: Sequence[str],
    strata: Sequence[str] = ("sector", "year", "state"),
    effort: str = "tgt_mt",
    unit: str = "dis_mt",
    group_col: str | None = None,
) -> DataFrame:
    """Expanded discards of several species in the given sectors."""
    return expand_to_fleet(
        derive_observer_strata(sector_filter(ob, keep=sectors)),
        derive_fleet_strata(sector_filter(fleet, keep=sectors)),
        list(strata),
        list(species),
        effort,
        unit,
        group_col=group_col,
    )
