"""Preparation of the inputs: derived strata, filters, program conventions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import clean_names, column_list, domain_list, require_columns
from ..functions.nulls import is_true, measure, null_safe_join
from ..functions.stats import stable_round
from .moments import ANALYSIS

# Sectors observed by the at-sea program.
AT_SEA_SECTORS = ["CATCHER-PROCESSOR", "MOTHERSHIP", "ATSEA TRIBAL"]
# Landing agency codes and their states.
AGENCY_STATES = {"C": "CA", "O": "OR", "W": "WA"}
# First and last month of the summer season.
SUMMER_MONTHS = (5, 10)

SHORE, AT_SEA = "shore", "at_sea"


def state_of_agency(code: Column) -> Column:
    """State of a landing agency code; NULL for any other code."""
    expr = None
    for value, state in AGENCY_STATES.items():
        expr = F.when(code == value, state) if expr is None else expr.when(code == value, state)
    return expr


def season_of_month(month: Column) -> Column:
    """``summer`` for the summer months, else ``winter``; an unknown month is winter."""
    return F.when(month.try_cast("int").between(*SUMMER_MONTHS), "summer").otherwise("winter")


def prefixed_stratum(prefix: str, value: Column) -> Column:
    """A stratum label built from text, such as ``CS - Bottom Trawl``."""
    return F.concat(F.lit(prefix), value)


def derive_fleet_strata(fleet: DataFrame) -> DataFrame:
    """State and season of landing lines, as far as their source columns exist."""
    out = fleet
    if "agency_code" in fleet.columns:
        out = out.withColumn("state", state_of_agency(F.col("agency_code")))
    if "landing_month" in fleet.columns:
        out = out.withColumn("season", season_of_month(F.col("landing_month")))
    return out


def derive_observer_strata(ob: DataFrame) -> DataFrame:
    """State, season and gear-based sector of observer records, as far as their sources exist."""
    out = ob
    if "r_state" in ob.columns:
        out = out.withColumn("state", F.col("r_state"))
    if "rmonth" in ob.columns:
        out = out.withColumn("season", season_of_month(F.col("rmonth")))
    if "cs_gear" in ob.columns:
        out = out.withColumn("cs_sector", prefixed_stratum("CS - ", F.col("cs_gear")))
    return out


def indicator_measure(
    df: DataFrame,
    out: str,
    value: str,
    domains: Sequence[str] | str,
    domain_col: str = "species",
    codes: Sequence[str] = (),
    code_col: str = "spid_eqv",
    disposition: str | None = "D",
    whole: bool = False,
) -> DataFrame:
    """Add ``value`` where the record is of a wanted domain (by name or code) and disposition, else 0.

    ``whole`` rounds counts up. An unknown disposition of a wanted domain gives NULL.
    """
    match = is_true(F.col(domain_col).isin(domain_list(domains)))
    if codes:
        match = match | is_true(F.col(code_col).isin(list(codes)))
    if disposition is not None:
        match = match & (F.col("catch_disposition") == disposition)
    amount = F.when(match.isNull(), F.lit(None).cast("double")).when(match, measure(value)).otherwise(F.lit(0.0))
    return df.withColumn(out, F.ceil(amount).cast("double") if whole else amount)


def sector_filter(
    df: DataFrame, keep: Sequence[str] | None = None, drop: Sequence[str] | None = None, col: str = "sector"
) -> DataFrame:
    """Keep or drop rows by sector; a missing sector is never in either list."""
    if keep is not None:
        df = df.where(F.col(col).isin(list(keep)))
    if drop is not None:
        df = df.where(F.col(col).isNull() | ~F.col(col).isin(list(drop)))
    return df


def sectors_with_domain(
    ob: DataFrame, domain: str, columns: Sequence[str] = ("sector", "gear"), domain_col: str = "species"
) -> DataFrame:
    """Distinct sectors (and gears) in which a domain occurs."""
    return ob.where(F.col(domain_col) == domain).select(*columns).distinct()


def restrict_to_sectors(df: DataFrame, sectors: DataFrame, col: str = "sector") -> DataFrame:
    """Rows whose sector is in the sector table, missing matching missing; a semi-join, no job while planning.

    Sectors are few and one may have a third of all records. Restrict aggregated rows where the column
    is among the strata; records only where it is not.
    """
    return null_safe_join(df, sectors.select(col).distinct(), [col], "left_semi")


def detect_program(ob: DataFrame, sector_col: str = "sector") -> str:
    """``at_sea`` if any record is from an at-sea sector.

    One short job: the sector test reaches the scan and a single matching row ends it. Pass the
    program explicitly to avoid it.
    """
    require_columns(ob, [sector_col], "observer table")
    hits = ob.select(sector_col).where(F.col(sector_col).isin(AT_SEA_SECTORS)).limit(1)
    return SHORE if hits.isEmpty() else AT_SEA


def program_normalise(
    ob: DataFrame, program: str, sector_col: str = "sector", trip_col: str = "trip_id"
) -> DataFrame:
    """Observer records under one convention.

    Shore-based data keep sampled records only. At-sea data take ``pwht_mt`` as target catch and
    have no trips. ``auto`` looks for at-sea sectors first, which reads the table once more.
    """
    df = clean_names(ob)
    if program == "auto":
        program = detect_program(df, sector_col)
    if program == SHORE:
        require_columns(df, ["datatype"], "observer table")
        return df.where(F.col("datatype") == ANALYSIS)
    if program == AT_SEA:
        require_columns(df, ["pwht_mt"], "observer table")
        trip_type = dict(df.dtypes).get(trip_col, "string")
        return df.withColumns({"tgt_mt": F.col("pwht_mt"), trip_col: F.lit(None).cast(trip_type)})
    raise ValueError(f"unknown program {program!r}: use 'auto', '{SHORE}' or '{AT_SEA}'")


def drop_empty_disposition(ob: DataFrame) -> DataFrame:
    """Records with a catch disposition; those without one are hauls without catch."""
    return ob.where(F.col("catch_disposition") != "")


def numeric_year(df: DataFrame, col: str = "year") -> DataFrame:
    """Year as double whatever its source type; text that is no number becomes NULL."""
    return df.withColumn(col, F.col(col).try_cast("double"))


def round_measures(df: DataFrame, keys: Sequence[str] | str, digits: int = 6) -> DataFrame:
    """Round every floating column but the keys."""
    keys = column_list(keys)
    floats = [c for c, t in df.dtypes if t in ("double", "float") and c not in keys]
    return df.withColumns({c: stable_round(F.col(c), digits) for c in floats}) if floats else df


def zero_fill(df: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """Missing numbers as 0 in every numeric column but the keys."""
    keys = column_list(keys)
    numeric = [c for c, t in df.dtypes if c not in keys and (t in ("double", "float", "int", "bigint", "smallint", "tinyint"))]
    return df.fillna(0, subset=numeric) if numeric else df
