"""Roll-ups of observer and fleet records by stratum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import column_list, domain_list, require_columns
from ..functions.nulls import divide, is_true, measure, n_distinct, strict_sum, sum_or_zero
from ..functions.stats import standard_error, zero_filled_se

UNIT_COLS = ("haul_id", "trip_id", "drvid")
# Fixed value: the record class that counts as sampled.
ANALYSIS = "Analysis Data"

BYCATCH_COLUMNS = ("total_byc", "mean_byc", "se_byc", "n_hauls_byc")


def by_unit(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Records dealt to tasks by their sampling unit, one task for each shuffle partition of the session.

    Adaptive execution merges what a plain aggregation shuffles up to its advisory size of packed bytes, which are millions of
    units; a task then holds them all, and several rows of each for the distinct counts that follow.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fleet_effort(
    fleet: DataFrame, strata: Sequence[str] | str, effort: str = "tgt_mt", moments: bool = False
) -> DataFrame:
    """Total fleet effort per stratum.

    ``moments=True`` gives the strict total, mean and standard error of the landing lines instead,
    each NULL where a line lacks its effort.
    """
    strata = column_list(strata)
    require_columns(fleet, [*strata, effort], "fleet table")
    value = measure(effort)
    if not moments:
        return fleet.groupBy(*strata).agg(sum_or_zero(value).alias("fleet_expf"))
    complete = F.count(F.lit(1)) == F.count(value)
    return fleet.groupBy(*strata).agg(
        strict_sum(value).alias("total_ft_expf"),
        F.when(complete, F.avg(value)).alias("mean_ft_expf"),
        F.when(complete, standard_error(value)).alias("se_ft_expf"),
    )


def observed_effort(
    ob: DataFrame,
    strata: Sequence[str] | str,
    effort: str = "tgt_mt",
    unit_cols: Sequence[str] = UNIT_COLS,
) -> DataFrame:
    """Effort moments over sampled hauls, with vessel, trip and haul counts per stratum."""
    strata = column_list(strata)
    haul, trip, vessel = unit_cols
    require_columns(ob, [*strata, *unit_cols, "datatype", effort], "observer table")
    sampled = ob.where(F.col(haul).isNotNull() & (F.col("datatype") == ANALYSIS))
    keys = [*strata, *unit_cols]
    records = by_unit(sampled.select(*keys, measure(effort).alias("__effort")), keys)
    hauls = records.groupBy(*keys).agg(sum_or_zero(F.col("__effort")).alias("expf_haul"))
    expf = F.col("expf_haul")
    return hauls.groupBy(*strata).agg(
        F.sum(expf).alias("total_expf"),
        F.avg(expf).alias("mean_expf"),
        standard_error(expf).alias("se_expf"),
        n_distinct(F.col(vessel)).alias("n_obs_ves"),
        n_distinct(F.col(trip)).alias("n_obs_trips"),
        F.count_distinct(haul).alias("n_obs_hauls"),
    )


def sample_sizes(
    ob: DataFrame, strata: Sequence[str] | str, unit_cols: Sequence[str] = UNIT_COLS
) -> DataFrame:
    """Distinct vessels, trips and hauls per stratum over all given records.

    The records are reduced to distinct units first, so the distinct counts run on hauls.
    """
    strata = column_list(strata)
    haul, trip, vessel = unit_cols
    require_columns(ob, [*strata, *unit_cols], "observer table")
    return (
        by_unit(ob.select(*strata, *unit_cols), [*strata, *unit_cols])
        .distinct()
        .groupBy(*strata)
        .agg(
            n_distinct(F.col(vessel)).alias("n_obs_ves"),
            n_distinct(F.col(trip)).alias("n_obs_trips"),
            n_distinct(F.col(haul)).alias("n_obs_hauls"),
        )
    )


def distinct_units(
    ob: DataFrame, strata: Sequence[str] | str, unit_cols: Sequence[str] = UNIT_COLS
) -> DataFrame:
    """The sampling units: distinct stratum, haul, trip and vessel with a haul id."""
    return ob.where(F.col(unit_cols[0]).isNotNull()).select(*column_list(strata), *unit_cols).distinct()


def domain_groups(ob: DataFrame, domains: Sequence[str], domain_col: str, group_col: str) -> DataFrame:
    """Each domain with the management groups it occurs in."""
    return ob.where(F.col(domain_col).isin(list(domains))).select(domain_col, group_col).distinct()


def stratum_domain_moments(
    ob: DataFrame,
    strata: Sequence[str] | str,
    domains: Sequence[str] | str,
    effort: str = "tgt_mt",
    unit: str = "dis_mt",
    domain_col: str = "species",
    group_col: str | None = None,
    unit_cols: Sequence[str] = UNIT_COLS,
    analysis_only: bool = False,
    effort_filter: bool = True,
) -> DataFrame:
    """Effort and zero-filled bycatch moments per stratum, domain (and group).

    One scan and no self-join: every record feeds its unit's effort row, records of a wanted
    domain feed a bycatch row as well. Both kinds go through the same two aggregations, so the
    wide shuffle carries one row per unit and one per unit and domain present. Units without a
    domain are never written out; their zeros enter through the moments' update formula.
    """
    strata, domains = column_list(strata), domain_list(domains)
    haul, trip, vessel = unit_cols
    needed = [*strata, *unit_cols, effort, unit, domain_col, *([group_col] if group_col else [])]
    sampled = F.lit(True)
    if effort_filter or analysis_only:
        needed.append("datatype")
        sampled = is_true(F.col("datatype") == ANALYSIS)
    require_columns(ob, needed, "observer table")
    if analysis_only:
        ob = ob.where(F.col("datatype") == ANALYSIS)

    keys = [*strata, "__kind", domain_col, *([group_col] if group_col else [])]
    is_domain = F.col("__kind") == 1
    wanted = is_true(F.col(domain_col).isin(domains))
    group = [F.when(is_domain, F.col(group_col)).alias(group_col)] if group_col else []
    # names and values that no row of the record needs are left out before it moves
    records = by_unit(
        ob.where(F.col(haul).isNotNull()).select(
            *strata,
            *unit_cols,
            F.when(wanted, F.col(domain_col)).alias(domain_col),
            *([F.when(wanted, F.col(group_col)).alias(group_col)] if group_col else []),
            sampled.alias("__sampled"),
            F.when(sampled, measure(effort)).alias("__effort"),
            F.when(wanted, measure(unit)).alias("__unit"),
        ),
        [*strata, *unit_cols],
    )
    named = F.col(domain_col).isNotNull()
    rows = (
        records.select("*", F.explode(F.when(named, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__kind"))
        .select(
            *strata,
            *unit_cols,
            "__kind",
            F.when(is_domain, F.col(domain_col)).alias(domain_col),
            *group,
            (~is_domain & F.col("__sampled")).alias("__sampled"),
            F.when(is_domain, F.col("__unit")).when(F.col("__sampled"), F.col("__effort")).alias("__value"),
        )
    )
    units = rows.groupBy(*keys, *unit_cols).agg(
        F.bool_or("__sampled").alias("__sampled"), sum_or_zero(F.col("__value")).alias("__value")
    )
    # Effort rows and bycatch rows share every buffer: few columns, since the distinct counts
    # send each row through the shuffle once per counted column.
    on_effort = F.col("__sampled")
    value = F.when(is_domain | on_effort, F.col("__value"))
    cells = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.count(value).alias("__n"),
        F.sum(value).alias("__total"),
        F.var_pop(value).alias("__var"),
        n_distinct(F.col(vessel), on_effort).alias("n_obs_ves"),
        n_distinct(F.col(trip), on_effort).alias("n_obs_trips"),
        F.count_distinct(F.when(on_effort | (is_domain & (value > 0)), F.col(haul))).alias("__hauls"),
    )

    all_domains = F.array(*[F.lit(d) for d in domains])
    dense = cells.withColumn(
        domain_col, F.explode(F.when(is_domain, F.array(F.col(domain_col))).otherwise(all_domains))
    )
    by = [*strata, domain_col]
    if group_col:
        # A stratum's effort row goes to every group of its domain, a bycatch row to its own.
        groups = domain_groups(ob, domains, domain_col, group_col).select(
            F.col(domain_col).alias("__d"), F.col(group_col).alias("__g")
        )
        own = ~is_domain | F.col("__g").eqNullSafe(F.col(group_col))
        dense = dense.join(groups, (F.col(domain_col) == F.col("__d")) & own, "left").withColumn(group_col, F.col("__g"))
        by.append(group_col)

    def from_kind(kind: int, name: str):
        return F.max(F.when(F.col("__kind") == kind, F.col(name)))

    names = ("__n", "__total", "__var", "__hauls")
    merged = dense.groupBy(*by).agg(
        from_kind(0, "__rows").alias("__units"),
        *[from_kind(0, c).alias(f"{c}_e") for c in names],
        *[from_kind(0, c).alias(c) for c in ("n_obs_ves", "n_obs_trips")],
        *[F.coalesce(from_kind(1, c), F.lit(0)).alias(f"{c}_b") for c in names],
    )

    def moments(side: str, units):
        """Total, mean and standard error over ``units`` units."""
        n, total, var = (F.col(f"{c}_{side}") for c in ("__n", "__total", "__var"))
        return [total, divide(total, units), zero_filled_se(divide(total, n), var, n, units)]

    sampled_any = F.col("__n_e") > 0
    effort_moments = [
        c.alias(a) for c, a in zip(moments("e", F.col("__n_e")), ("total_expf", "mean_expf", "se_expf"))
    ]
    byc_moments = [c.alias(a) for c, a in zip(moments("b", F.col("__units")), BYCATCH_COLUMNS)]
    counts = {"n_obs_ves": "n_obs_ves", "n_obs_trips": "n_obs_trips", "n_obs_hauls": "__hauls_e"}
    return merged.select(
        *by,
        *effort_moments,
        *[F.when(sampled_any, F.col(c)).alias(a) for a, c in counts.items()],
        *byc_moments,
        F.col("__hauls_b").alias("n_hauls_byc"),
    )


def zero_filled_bycatch(
    ob: DataFrame,
    strata: Sequence[str] | str,
    domains: Sequence[str] | str,
    unit: str = "dis_mt",
    domain_col: str = "species",
    group_col: str | None = None,
    unit_cols: Sequence[str] = UNIT_COLS,
    analysis_only: bool = False,
) -> DataFrame:
    """Bycatch moments per stratum and domain, units without the domain counting as zero."""
    table = stratum_domain_moments(
        ob,
        strata,
        domains,
        effort=unit,
        unit=unit,
        domain_col=domain_col,
        group_col=group_col,
        unit_cols=unit_cols,
        analysis_only=analysis_only,
        effort_filter=analysis_only,
    )
    return table.select(*column_list(strata), domain_col, *([group_col] if group_col else []), *BYCATCH_COLUMNS)


def union_domains(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts by column name; a column a part lacks is NULL there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
