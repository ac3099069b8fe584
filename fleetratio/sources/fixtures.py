"""Observer and fleet views over order, line item, part and supplier tables.

Every line item is a catch record and a landing line. Both views are projections over the whole
tables; only the dimensions a view's columns need are joined, their join strategy is left to the
planner.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

# Declared so that opening a table starts no inference job.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
}

_ORDER, _PART, _REGION = "orders", "part", "region"

# A sector and year in which no haul was observed.
_NEVER = "(r_name = 'ASIA' AND year(o_orderdate) = 2001)"
_DATATYPE = f"""CASE WHEN {_NEVER} OR o_custkey % 50 = 0 THEN 'Failed Data'
  WHEN l_orderkey % 40 = 4 THEN 'Unsampled IFQ'
  WHEN l_orderkey % 40 = 8 THEN 'Unsampled ZMIS'
  ELSE 'Analysis Data' END"""
_COMMON_NAME = f"""CASE WHEN {_DATATYPE} = 'Unsampled IFQ' AND l_linestatus = 'F' THEN 'Non-IFQ Fish Species'
  WHEN {_DATATYPE} = 'Unsampled ZMIS' AND l_linestatus = 'F' THEN 'Misc Mixed Species'
  WHEN {_DATATYPE} = 'Unsampled ZMIS' THEN 'Unsorted catch not sampled'
  ELSE p_type END"""
_TICKETS = """CASE WHEN l_linenumber = 6 THEN ''
  WHEN l_linenumber = 7 THEN concat('T', l_orderkey, ';X', l_orderkey)
  ELSE concat('T', l_orderkey) END"""
_STATE = "CASE l_suppkey % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'OR' WHEN 2 THEN 'WA' END"
_AGENCY = "CASE l_suppkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'O' WHEN 2 THEN 'W' ELSE 'X' END"
_SIDE = "CASE WHEN l_suppkey % 2 = 0 THEN 'North' ELSE 'South' END"
_RETAINED = "CASE WHEN l_returnflag = 'R' THEN 0D ELSE l_quantity / 10 END"

# View column: its expression and the dimensions it reads beyond the line item.
_SHARED = {
    "sector": ("r_name", [_REGION]),
    "year": ("year(o_orderdate)", [_ORDER]),
    "gear": ("o_orderpriority", [_ORDER]),
    "drvid": ("l_suppkey", []),
    "tgt_mt": (_RETAINED, []),
    "gfr_mt": (f"CASE WHEN p_size % 2 = 0 THEN {_RETAINED} ELSE 0D END", [_PART]),
}
OBSERVER = {
    **_SHARED,
    "cs_gear": ("o_orderpriority", [_ORDER]),
    "rmonth": ("month(o_orderdate)", [_ORDER]),
    "r_state": (_STATE, []),
    "trip_id": (f"CASE WHEN NOT {_NEVER} THEN o_custkey END", [_ORDER, _REGION]),
    "haul_id": (f"CASE WHEN NOT {_NEVER} AND l_orderkey % 200 <> 0 THEN l_orderkey END", [_ORDER, _REGION]),
    "fish_tickets": (_TICKETS, []),
    "species": ("p_type", [_PART]),
    "spid_eqv": ("substring(p_type, 1, 4)", [_PART]),
    "grouping": (f"concat(p_type, ' (', {_SIDE}, ' of 40<b0>10)')", [_PART]),
    "datatype": (_DATATYPE, [_ORDER, _REGION]),
    "catch_disposition": ("CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'R' END", []),
    "common_name": (_COMMON_NAME, [_ORDER, _REGION, _PART]),
    "ifq": (f"CASE WHEN {_COMMON_NAME} <> 'Non-IFQ Fish Species' THEN p_size % 2 END", [_ORDER, _REGION, _PART]),
    "mt": ("l_quantity / 10", []),
    "dis_mt": ("CASE WHEN l_returnflag = 'R' THEN l_quantity / 10 ELSE 0D END", []),
    "pwht_mt": ("l_quantity / 20", []),
    "exp_sp_ct": ("l_linenumber", []),
    "exp_sp_wt": ("l_extendedprice / 100", []),
}
FLEET = {
    **_SHARED,
    "landing_month": ("month(o_orderdate)", [_ORDER]),
    "agency_code": (_AGENCY, []),
    "ftid": ("concat('T', l_orderkey)", []),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", schema=SCHEMAS[name])


def _view(spark: SparkSession, sf_dir: str, exprs: dict, columns: Sequence[str] | None) -> DataFrame:
    names = list(exprs) if columns is None else list(dict.fromkeys(columns))
    needs = {d for c in names for d in exprs[c][1]}
    sources = {"lineitem": table(spark, sf_dir, "lineitem")}
    joins = ""
    if _ORDER in needs:
        sources["orders"] = table(spark, sf_dir, "orders")
        joins += " JOIN {orders} ON l_orderkey = o_orderkey"
    if _PART in needs:
        sources["part"] = table(spark, sf_dir, "part")
        joins += " JOIN {part} ON l_partkey = p_partkey"
    if _REGION in needs:
        sources.update({t: table(spark, sf_dir, t) for t in ("supplier", "nation", "region")})
        joins += (
            " JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey"
            " JOIN {region} ON n_regionkey = r_regionkey"
        )
    columns_sql = ", ".join(f"{exprs[c][0]} AS `{c}`" for c in names)
    return spark.sql(f"SELECT {columns_sql} FROM {{lineitem}}{joins}", **sources)


def observer_view(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Catch records; all columns, or only the given ones."""
    return _view(spark, sf_dir, OBSERVER, columns)


def fleet_view(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Landing lines; all columns, or only the given ones."""
    return _view(spark, sf_dir, FLEET, columns)
