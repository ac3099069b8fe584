"""Plain SQL for every registered query, written independently of the Spark plans.

Where the plans use sparse moments, hashes or arrays, the SQL builds the dense table.
"""

from __future__ import annotations

import re

BASE = """
WITH base AS (
  SELECT *, (r_name = 'ASIA' AND year(o_orderdate) = 2001) AS never
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
typed AS (
  SELECT *,
    CASE WHEN never OR o_custkey % 50 = 0 THEN 'Failed Data'
         WHEN l_orderkey % 40 = 4 THEN 'Unsampled IFQ'
         WHEN l_orderkey % 40 = 8 THEN 'Unsampled ZMIS'
         ELSE 'Analysis Data' END AS datatype
  FROM base
),
named AS (
  SELECT *,
    CASE WHEN datatype = 'Unsampled IFQ' AND l_linestatus = 'F' THEN 'Non-IFQ Fish Species'
         WHEN datatype = 'Unsampled ZMIS' AND l_linestatus = 'F' THEN 'Misc Mixed Species'
         WHEN datatype = 'Unsampled ZMIS' THEN 'Unsorted catch not sampled'
         ELSE p_type END AS common_name
  FROM typed
),
ob AS (
  SELECT
    r_name AS sector,
    CAST(year(o_orderdate) AS INTEGER) AS "year",
    o_orderpriority AS gear,
    CAST(month(o_orderdate) AS INTEGER) AS rmonth,
    CASE l_suppkey % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'OR' WHEN 2 THEN 'WA' END AS r_state,
    CASE l_suppkey % 4 WHEN 0 THEN 'CA' WHEN 1 THEN 'OR' WHEN 2 THEN 'WA' END AS state,
    CASE WHEN month(o_orderdate) BETWEEN 5 AND 10 THEN 'summer' ELSE 'winter' END AS season,
    l_suppkey AS drvid,
    CASE WHEN NOT never THEN o_custkey END AS trip_id,
    CASE WHEN NOT never AND l_orderkey % 200 <> 0 THEN l_orderkey END AS haul_id,
    CASE WHEN l_linenumber = 6 THEN ''
         WHEN l_linenumber = 7 THEN 'T' || l_orderkey || ';X' || l_orderkey
         ELSE 'T' || l_orderkey END AS fish_tickets,
    p_type AS species,
    substr(p_type, 1, 4) AS spid_eqv,
    p_type || ' (' || CASE WHEN l_suppkey % 2 = 0 THEN 'North' ELSE 'South' END || ' of 40<b0>10)' AS "grouping",
    datatype,
    CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'R' END AS catch_disposition,
    common_name,
    CASE WHEN common_name <> 'Non-IFQ Fish Species' THEN p_size % 2 END AS ifq,
    l_quantity / 10 AS mt,
    CASE WHEN l_returnflag = 'R' THEN l_quantity / 10 ELSE 0 END AS dis_mt,
    CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity / 10 END AS tgt_mt,
    CASE WHEN l_returnflag <> 'R' AND p_size % 2 = 0 THEN l_quantity / 10 ELSE 0 END AS gfr_mt,
    l_quantity / 20 AS pwht_mt,
    CAST(l_linenumber AS DOUBLE) AS exp_sp_ct,
    l_extendedprice / 100 AS exp_sp_wt
  FROM named
),
fleet AS (
  SELECT
    sector, "year", gear, tgt_mt, gfr_mt, drvid, rmonth AS landing_month, season, state,
    CASE drvid % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'O' WHEN 2 THEN 'W' ELSE 'X' END AS agency_code
  FROM ob
)
"""

SPECIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SECTORS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SYG = ["sector", "year", "gear"]
SY = ["sector", "year"]
UNITS = ["haul_id", "trip_id", "drvid"]


def q(names, prefix=""):
    return ", ".join(f'{prefix}"{n}"' for n in names)


def same(a, b, names):
    """NULL-safe equality of the named columns of two relations."""
    return " AND ".join(f'{a}."{n}" IS NOT DISTINCT FROM {b}."{n}"' for n in names)


def merged(a, b, names):
    return ", ".join(f'coalesce({a}."{n}", {b}."{n}") AS "{n}"' for n in names)


def rounded(names, digits=6):
    return ", ".join(f'round({n}, {digits}) AS {n}' for n in names)


def distinct(col):
    return f"count(DISTINCT {col}) + coalesce(max(CASE WHEN {col} IS NULL THEN 1 END), 0)"


def values(domains):
    return ", ".join(f"('{d}')" for d in domains)


def se_of_ratio(mx, my, sx, sy):
    rel = f"(pow({sx} / nullif({mx}, 0), 2) + pow({sy} / nullif({my}, 0), 2)" \
          f" - pow({sx} / nullif({mx}, 0), 2) * pow({sy} / nullif({my}, 0), 2))"
    return f"sqrt(pow({mx} / nullif({my}, 0), 2) * {rel})"


EFFORT_COLS = ["total_expf", "mean_expf", "se_expf", "n_obs_ves", "n_obs_trips", "n_obs_hauls"]
BYC_COLS = ["total_byc", "mean_byc", "se_byc", "n_hauls_byc"]


def effort_ctes(strata, effort, src="ob", sampled="datatype = 'Analysis Data'"):
    return f"""
eff_h AS (
  SELECT {q(strata)}, {q(UNITS)}, coalesce(sum({effort}), 0) AS e
  FROM {src} WHERE haul_id IS NOT NULL AND {sampled} GROUP BY {q(strata)}, {q(UNITS)}
),
eff AS (
  SELECT {q(strata)}, sum(e) AS total_expf, avg(e) AS mean_expf, sqrt(var_samp(e) / count(*)) AS se_expf,
    {distinct('drvid')} AS n_obs_ves, {distinct('trip_id')} AS n_obs_trips, {distinct('haul_id')} AS n_obs_hauls
  FROM eff_h GROUP BY {q(strata)}
)"""


def bycatch_ctes(strata, unit, domains, src="ob", group=None):
    """Every unit times every domain (and its groups), zero where nothing was caught."""
    dims = ["species"] + ([group] if group else [])
    if group:
        dom = f"""dom AS (
  SELECT DISTINCT v.species, o."{group}" FROM (VALUES {values(domains)}) v(species)
  LEFT JOIN {src} o ON o.species = v.species
)"""
    else:
        dom = f"dom AS (SELECT species FROM (VALUES {values(domains)}) v(species))"
    return f"""
{dom},
grid AS (
  SELECT g.*, {q(dims, 'd.')} FROM
    (SELECT DISTINCT {q(strata)}, {q(UNITS)} FROM {src} WHERE haul_id IS NOT NULL) g CROSS JOIN dom d
),
caught AS (
  SELECT {q(strata)}, {q(UNITS)}, {q(dims)}, sum({unit}) AS b FROM {src} GROUP BY {q(strata)}, {q(UNITS)}, {q(dims)}
),
byc_h AS (
  SELECT g.*, coalesce(c.b, 0) AS b FROM grid g LEFT JOIN caught c ON {same('g', 'c', strata + UNITS + dims)}
),
byc AS (
  SELECT {q(strata)}, {q(dims)}, sum(b) AS total_byc, avg(b) AS mean_byc,
    sqrt(var_samp(b) / count(*)) AS se_byc, count(DISTINCT CASE WHEN b > 0 THEN haul_id END) AS n_hauls_byc
  FROM byc_h GROUP BY {q(strata)}, {q(dims)}
)"""


RATIO_COLS = ["byc_ratio", "byc_se", "byc_ratio_lower", "byc_ratio_upper"]


def ratio_ctes(strata, effort, unit, domains, group=None, src="ob"):
    dims = ["species"] + ([group] if group else [])
    return f"""
{effort_ctes(strata, effort, src)},
{bycatch_ctes(strata, unit, domains, src, group)},
joined AS (
  SELECT {q(strata, 'b.')}, {q(dims, 'b.')}, {q(EFFORT_COLS, 'e.')}, {q(BYC_COLS, 'b.')},
    b.total_byc / nullif(e.total_expf, 0) AS byc_ratio,
    {se_of_ratio('b.mean_byc', 'e.mean_expf', 'b.se_byc', 'e.se_expf')} AS byc_se,
    round(b.n_hauls_byc / nullif(e.n_obs_hauls, 0) * 100, 2) AS pct_hauls_byc
  FROM byc b LEFT JOIN eff e ON {same('b', 'e', strata)}
),
ratios AS (
  SELECT *, byc_ratio - 1.96 * byc_se AS byc_ratio_lower, byc_ratio + 1.96 * byc_se AS byc_ratio_upper FROM joined
)"""


MOMENTS = ["total_expf", "mean_expf", "se_expf", "total_byc", "mean_byc", "se_byc"]
COUNTS = ["n_obs_ves", "n_obs_trips", "n_obs_hauls", "n_hauls_byc", "pct_hauls_byc"]


def ratio_sql(strata, effort, unit, domains, group=None):
    dims = ["species"] + ([group] if group else [])
    return f"""{BASE}, {ratio_ctes(strata, effort, unit, domains, group)}
SELECT {q(strata + dims)}, {rounded(MOMENTS + RATIO_COLS)}, {q(COUNTS)} FROM ratios"""


def expand_ctes(strata, effort, unit, domains, group=None, src="ob", fleet="fleet"):
    label = f"replace(r.\"{group}\", '<b0>', '°') AS \"{group}\"," if group else ""
    rest = EFFORT_COLS + BYC_COLS + RATIO_COLS + ["pct_hauls_byc"]
    return f"""{ratio_ctes(strata, effort, unit, domains, group, src)},
land AS (
  SELECT f.*, v.species FROM
    (SELECT {q(strata)}, coalesce(sum({effort}), 0) AS fleet_expf FROM {fleet} GROUP BY {q(strata)}) f
    CROSS JOIN (VALUES {values(domains)}) v(species)
),
expanded AS (
  SELECT {merged('f', 'r', strata + ['species'])}, {label} f.fleet_expf, {q(rest, 'r.')},
    round(r.total_expf / nullif(f.fleet_expf, 0) * 100, 2) AS pct_cvg,
    r.byc_ratio * f.fleet_expf AS est_byc,
    r.byc_ratio_lower * f.fleet_expf AS est_byc_lower,
    r.byc_ratio_upper * f.fleet_expf AS est_byc_upper
  FROM land f FULL JOIN ratios r ON {same('f', 'r', strata + ['species'])}
)"""


def clean_sql(strata, domains, group=None, src="ob", fleet="fleet", extra=""):
    dims = ["species"] + ([group] if group else [])
    return f"""{BASE}{extra}, {expand_ctes(strata, 'tgt_mt', 'dis_mt', domains, group, src, fleet)},
report AS (
  SELECT {q(strata + dims)}, round(total_byc, 3) AS obs_byc, round(total_expf, 3) AS obs_expf,
    round(fleet_expf, 3) AS fleet_expf, coalesce(pct_cvg, 0) AS pct_cvg, coalesce(n_obs_ves, 0) AS n_obs_ves,
    coalesce(n_obs_trips, 0) AS n_obs_trips, coalesce(n_obs_hauls, 0) AS n_obs_hauls, n_hauls_byc, pct_hauls_byc,
    round(byc_ratio, 5) AS byc_ratio, round(est_byc, 3) AS est_byc, round(est_byc_lower, 3) AS lo,
    round(est_byc_upper, 3) AS est_byc_upper
  FROM expanded
)
SELECT * EXCLUDE (lo), CASE WHEN lo IS NULL OR obs_byc IS NULL THEN NULL WHEN lo < obs_byc THEN obs_byc ELSE lo END
  AS est_byc_lower FROM report"""


def key_text(columns):
    """One text for several values, separators in a value escaped, missing ones marked."""
    part = "coalesce('V' || replace(replace(CAST(\"{}\" AS VARCHAR), '\\', '\\\\'), '|', '\\|'), 'N')"
    return " || '|' || ".join(part.format(c) for c in columns)


def hashed(seed, node, rep, j):
    """Number ``j`` of a node in a replicate: eight hex digits of the md5 that serves four draws."""
    return f"CAST(('0x' || substr(md5('{seed}|' || salt || '|' || {node} || '|' || {rep} || '|' || ({j} // 4)), CAST(8 * ({j} % 4) + 1 AS INTEGER), 8)) AS BIGINT)"


def boot_ctes(strata, unit, domains, reps, unit_strata=None, src="ad", seed=42, node=4096, domain_col="species"):
    """Deal the draws to nodes of the tree by md5, draw in each node, look the unit up; ``src`` holds sampled records only."""
    us = unit_strata or strata
    order = [c for c in us if c not in strata] + ["drvid"]
    salt = key_text(strata)
    return f"""
ves AS (
  SELECT {q(us)}, drvid, coalesce(sum(tgt_mt), 0) AS e FROM {src} GROUP BY {q(us)}, drvid
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {q(strata)} ORDER BY md5({key_text(order)}), {', '.join(f'"{c}" NULLS FIRST' for c in order)}) - 1 AS idx,
    count(*) OVER (PARTITION BY {q(strata)}) AS n
  FROM ves WHERE e > 0
),
ves_byc AS (
  SELECT n.*, v.species, coalesce(c.b, 0) AS b
  FROM numbered n CROSS JOIN (VALUES {values(domains)}) v(species)
  LEFT JOIN (SELECT {q(us)}, drvid, {domain_col} AS species, sum({unit}) AS b FROM {src} GROUP BY ALL) c
    ON {same('n', 'c', us + ['drvid'])} AND c.species = v.species
),
strat AS (
  SELECT DISTINCT {q(strata)}, n, {salt} AS salt FROM numbered
),
dealt AS (
  SELECT salt, rep, ({hashed(seed, -1, 'r.rep', 'j.j')} % n) // {node} AS node, count(*) AS share
  FROM strat CROSS JOIN (SELECT unnest(range(1, {reps} + 1)) AS rep) r CROSS JOIN LATERAL (SELECT unnest(range(0, strat.n)) AS j) j
  WHERE n > {node} GROUP BY ALL
),
shares AS (
  SELECT s.*, d.rep, d.node, d.share FROM strat s JOIN dealt d USING (salt)
  UNION ALL SELECT s.*, r.rep, 0, s.n FROM strat s CROSS JOIN (SELECT unnest(range(1, {reps} + 1)) AS rep) r WHERE s.n <= {node}
),
draws AS (
  SELECT s.*, s.node * {node} + {hashed(seed, 's.node', 's.rep', 'j.j')} % least({node}, n - s.node * {node}) AS idx
  FROM shares s CROSS JOIN LATERAL (SELECT unnest(range(0, s.share)) AS j) j
),
reps AS (
  SELECT {q(strata, 'd.')}, v.species, d.rep, sum(v.b) / sum(v.e) AS ratio
  FROM draws d JOIN ves_byc v ON {same('d', 'v', strata)} AND d.idx = v.idx
  GROUP BY {q(strata, 'd.')}, v.species, d.rep
),
boot AS (
  SELECT p.*, s.median_ratio, s.mean_ratio, s.lower_ci, s.upper_ci FROM
    (SELECT {q(strata)}, species, sum(b) / sum(e) AS point_est_ratio FROM ves_byc GROUP BY {q(strata)}, species) p
    JOIN (SELECT {q(strata)}, species, quantile_cont(ratio, 0.5) AS median_ratio, avg(ratio) AS mean_ratio,
            quantile_cont(ratio, 0.025) AS lower_ci, quantile_cont(ratio, 0.975) AS upper_ci
          FROM reps GROUP BY {q(strata)}, species) s
    ON {same('p', 's', strata + ['species'])}
)"""


AD = ", ad AS (SELECT * FROM ob WHERE datatype = 'Analysis Data')"
AT_SEA = """, ad AS (
  SELECT * REPLACE (CASE WHEN sector = 'ASIA' THEN 'MOTHERSHIP' ELSE sector END AS sector, pwht_mt AS tgt_mt,
    CAST(NULL AS BIGINT) AS trip_id) FROM ob)"""
KINDS = ", ad AS (SELECT *, species || ' ' || sector AS kind FROM ob WHERE datatype = 'Analysis Data')"
FORTY = [f"{s} {r}" for s in SPECIES for r in SECTORS] + [f"NEVER {i}" for i in range(10)]
BOOT_COLS = ["point_est_ratio", "median_ratio", "mean_ratio", "lower_ci", "upper_ci"]


def observed_ctes(strata, unit, domains, src="ad"):
    return f"""{effort_ctes(strata, 'tgt_mt', src, 'TRUE')},
{bycatch_ctes(strata, unit, domains, src)},
seen AS (
  SELECT {q(strata, 'b.')}, b.species, {q(EFFORT_COLS, 'e.')}, {q(BYC_COLS, 'b.')}
  FROM byc b LEFT JOIN eff e ON {same('b', 'e', strata)}
)"""


DERIVED = """round(n_hauls_byc / nullif(n_obs_hauls, 0) * 100, 2) AS pct_hauls_byc,
  round(total_byc / nullif(total_expf, 0), 6) AS byc_ratio"""


def boot_ratio_sql(strata, unit, domains, reps, unit_strata=None, ad=AD, node=4096):
    return f"""{BASE}{ad}, {boot_ctes(strata, unit, domains, reps, unit_strata, node=node)},
{observed_ctes(strata, unit, domains)},
both_ AS (
  SELECT {merged('b', 'o', strata + ['species'])}, {q(BOOT_COLS, 'b.')}, {q(EFFORT_COLS + BYC_COLS, 'o.')}
  FROM boot b FULL JOIN seen o ON {same('b', 'o', strata + ['species'])}
)
SELECT {q(strata + ['species'])}, {rounded(BOOT_COLS + MOMENTS)}, {q(COUNTS[:4])}, {DERIVED} FROM both_"""


def boot_expand_sql(strata, unit, domains, reps, ad=AD, unit_strata=None, complete=False):
    spread = f"CROSS JOIN (VALUES {values(domains)}) v(species)" if complete else ""
    species, key = ("coalesce(f.species, b.species) AS species", strata + ["species"]) if complete else ("b.species", strata)
    return f"""{BASE}{ad}, {boot_ctes(strata, unit, domains, reps, unit_strata)},
{observed_ctes(strata, unit, domains)},
land AS (
  SELECT * FROM (SELECT {q(strata)}, coalesce(sum(tgt_mt), 0) AS fleet_expf FROM fleet GROUP BY {q(strata)}) {spread}
),
step AS (
  SELECT {merged('f', 'b', strata)}, {species}, f.fleet_expf, {q(BOOT_COLS, 'b.')}
  FROM land f FULL JOIN boot b ON {same('f', 'b', key)}
),
both_ AS (
  SELECT {merged('s', 'o', strata + ['species'])}, s.fleet_expf, {q(BOOT_COLS, 's.')}, {q(EFFORT_COLS + BYC_COLS, 'o.')}
  FROM step s FULL JOIN seen o ON {same('s', 'o', strata + ['species'])}
)
SELECT {q(strata + ['species'])}, {rounded(['fleet_expf'] + BOOT_COLS + MOMENTS)}, {q(COUNTS[:4])}, {DERIVED},
  round(total_expf / nullif(fleet_expf, 0) * 100, 2) AS pct_cvg,
  round(total_byc / nullif(total_expf, 0) * fleet_expf, 6) AS est_byc,
  round(mean_ratio * fleet_expf, 6) AS est_byc_mean_ratio,
  round(median_ratio * fleet_expf, 6) AS est_byc_med_ratio,
  round(lower_ci * fleet_expf, 6) AS est_byc_lower,
  round(CASE WHEN lower_ci * fleet_expf < total_byc THEN total_byc
             WHEN total_byc IS NOT NULL THEN lower_ci * fleet_expf END, 6) AS est_byc_lower_trunc,
  round(upper_ci * fleet_expf, 6) AS est_byc_upper
FROM both_"""


def strict(value, cond="TRUE"):
    """NULL as soon as a row's condition is unknown, or holds while its value is missing."""
    return (
        f"CASE WHEN coalesce(bool_or(({cond}) IS NULL OR (({cond}) AND ({value}) IS NULL)), FALSE) THEN NULL "
        f"ELSE coalesce(sum(CASE WHEN {cond} THEN {value} END), 0) END"
    )


NIFQ_RECORD = """(datatype = 'Unsampled IFQ' AND (common_name = 'Non-IFQ Fish Species' OR ifq = 0)
  AND catch_disposition = 'D')"""


def lenient(value, cond="TRUE"):
    """Missing values and unknown conditions left out."""
    return f"coalesce(sum(CASE WHEN {cond} THEN {value} END), 0)"


def unsampled_sql(select=None, domains=(("PROMO", False), ("SMALL", True)), total=strict):
    k = ["year", "r_state"]
    seen = "(datatype = 'Analysis Data' OR (datatype = 'Unsampled IFQ' AND common_name <> 'Non-IFQ Fish Species'))"
    own = "o.species = d.bycsp AND datatype = 'Analysis Data' AND catch_disposition = 'D'"
    in_set = "EXISTS (SELECT 1 FROM hset h WHERE h.bycsp = d.bycsp AND h.haul_id IS NOT DISTINCT FROM o.haul_id)"
    failed = "(trip_id IN (SELECT trip_id FROM failed WHERE trip_id IS NOT NULL) OR " \
             "(trip_id IS NULL AND EXISTS (SELECT 1 FROM failed WHERE trip_id IS NULL)))"
    nifq = "datatype = 'Unsampled IFQ' AND common_name = 'Non-IFQ Fish Species' AND catch_disposition = 'D' AND chosen"

    def component(c, u):
        num, den, fac = (f"{c}_num_{u}", f"{c}_denom", f"{c}_expf")
        return f"""CASE WHEN {num} IS NULL OR {den} IS NULL OR {fac} IS NULL THEN NULL
    WHEN {den} = 0 AND ({num} = 0 OR {fac} = 0) THEN 0 ELSE {num} / nullif({den}, 0) * {fac} END AS est_{c}_{u}"""

    def n_where(col, cond):
        return f"count(DISTINCT CASE WHEN {cond} THEN {col} END) + " \
               f"coalesce(max(CASE WHEN ({cond}) IS NULL OR (({cond}) AND {col} IS NULL) THEN 1 END), 0)"

    comps = ("nifq", "zmis", "unst", "fail")
    nums = ", ".join(f"num_ct AS {c}_num_ct, num_wt AS {c}_num_wt" for c in comps)
    ests = [f"est_{c}_{u}" for c in comps for u in ("ct", "wt")]
    factors = [f"{c}_{p}" for c in comps for p in ("num_ct", "num_wt", "denom", "expf")]
    out = factors + ests + ["obs_tgt_mt", "obs_byc_ct", "obs_byc_wt", "unobs_tgt_mt", "total_tgt_mt"]
    return f"""{BASE},
nifq_hauls AS (SELECT DISTINCT haul_id FROM ob WHERE {NIFQ_RECORD}),
present AS (SELECT DISTINCT haul_id, species FROM ob WHERE catch_disposition = 'D'),
dom AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {always})" for s, always in domains)}) d(bycsp, always)),
hset AS (
  SELECT n.haul_id, d.bycsp FROM nifq_hauls n CROSS JOIN dom d
  WHERE d.always OR NOT EXISTS (SELECT 1 FROM present p WHERE p.species = d.bycsp AND p.haul_id IS NOT DISTINCT FROM n.haul_id)
),
failed AS (SELECT DISTINCT trip_id FROM ob WHERE datatype = 'Failed Data'),
marked AS (
  SELECT o.*, d.bycsp, {own} AS own, {seen} AS seen, {failed} AS in_failed, {in_set} AS chosen
  FROM ob o CROSS JOIN dom d
),
sums AS (
  SELECT {q(k)}, bycsp,
    {total('exp_sp_ct', 'own')} AS num_ct, {total('exp_sp_wt / 2204.6', 'own')} AS num_wt,
    {total('mt', "ifq = 0 AND datatype = 'Analysis Data' AND catch_disposition = 'D'")} AS nifq_denom,
    {total('mt', nifq)} AS nifq_expf,
    {total('mt', "datatype = 'Analysis Data' AND catch_disposition = 'D'")} AS zmis_denom,
    {total('mt', "datatype = 'Unsampled ZMIS' AND common_name = 'Misc Mixed Species' AND catch_disposition = 'D'")} AS zmis_expf,
    {total('mt', "datatype = 'Analysis Data'")} AS unst_denom,
    {total('mt', "datatype = 'Unsampled ZMIS' AND common_name = 'Unsorted catch not sampled' AND catch_disposition = 'D'")} AS unst_expf,
    {total('tgt_mt', "datatype = 'Analysis Data'")} AS fail_denom,
    {total('tgt_mt', 'in_failed')} AS fail_expf,
    coalesce(sum(CASE WHEN seen THEN tgt_mt END), 0) AS obs_tgt_mt,
    coalesce(sum(CASE WHEN NOT seen THEN tgt_mt END), 0) AS unobs_tgt_mt,
    {n_where('haul_id', 'seen')} AS obs_hauls, {n_where('drvid', 'seen')} AS n_obs_ves,
    {n_where('haul_id', 'NOT seen')} AS unobs_hauls
  FROM marked GROUP BY {q(k)}, bycsp
),
named_sums AS (SELECT *, {nums}, num_ct AS obs_byc_ct, num_wt AS obs_byc_wt, obs_tgt_mt + unobs_tgt_mt AS total_tgt_mt FROM sums),
est AS (SELECT *, {', '.join(component(c, u) for c in comps for u in ('ct', 'wt'))} FROM named_sums)
""" + (select or f"""SELECT {q(k)}, bycsp, {rounded(out)}, obs_hauls, n_obs_ves, unobs_hauls,
  round({' + '.join(f'est_{c}_ct' for c in comps)}, 6) AS est_unsamp_ct,
  round({' + '.join(f'est_{c}_wt' for c in comps)}, 6) AS est_unsamp_wt,
  round(obs_byc_ct + {' + '.join(f'est_{c}_ct' for c in comps)}, 6) AS total_byc_ct,
  round(obs_byc_wt + {' + '.join(f'est_{c}_wt' for c in comps)}, 6) AS total_byc_wt,
  round(obs_tgt_mt / nullif(total_tgt_mt, 0) * 100, 1) AS pct_tgt_obs
FROM est""")


SINGLE = f"""{BASE},
units AS (
  SELECT {q(SY)}, {q(UNITS)}, sum(CASE WHEN species = 'PROMO' AND catch_disposition = 'D' THEN dis_mt ELSE 0 END) AS b,
    coalesce(sum(tgt_mt), 0) AS e
  FROM ob WHERE datatype = 'Analysis Data' GROUP BY {q(SY)}, {q(UNITS)}
),
seen AS (
  SELECT {q(SY)}, sum(b) AS total_byc, avg(b) AS mean_byc, sqrt(var_samp(b) / count(*)) AS se_byc, sum(e) AS total_expf,
    avg(e) AS mean_expf, sqrt(var_samp(e) / count(*)) AS se_expf, {distinct('drvid')} AS n_obs_ves,
    {distinct('trip_id')} AS n_obs_trips, {distinct('haul_id')} AS n_obs_hauls
  FROM units GROUP BY {q(SY)}
),
land AS (
  SELECT {q(SY)}, sum(tgt_mt) AS total_ft_expf, avg(tgt_mt) AS mean_ft_expf, sqrt(var_samp(tgt_mt) / count(*)) AS se_ft_expf
  FROM fleet GROUP BY {q(SY)}
),
filled AS (
  SELECT {merged('s', 'f', SY)}, {', '.join(f'coalesce({c}, 0) AS {c}' for c in
    ['total_byc', 'mean_byc', 'se_byc', 'total_expf', 'mean_expf', 'se_expf', 'n_obs_ves', 'n_obs_trips', 'n_obs_hauls',
     'total_ft_expf', 'mean_ft_expf', 'se_ft_expf'])}
  FROM seen s FULL JOIN land f ON {same('s', 'f', SY)}
),
ratio AS (
  SELECT *, total_byc / nullif(total_expf, 0) AS byc_ratio,
    {se_of_ratio('mean_byc', 'mean_expf', 'se_byc', 'se_expf')} AS byc_se
  FROM filled
),
bounds AS (
  SELECT *, byc_ratio - 1.96 * byc_se AS byc_ratio_lower, byc_ratio + 1.96 * byc_se AS byc_ratio_upper,
    coalesce((byc_ratio - 1.96 * byc_se) * total_ft_expf, 0) AS lo,
    coalesce((byc_ratio + 1.96 * byc_se) * total_ft_expf, 0) AS expand_byc_upper,
    byc_ratio * total_ft_expf AS expand_byc,
    total_expf / nullif(total_ft_expf, 0) * 100 AS pct_cvg
  FROM ratio
)
SELECT {q(SY)}, n_obs_ves, n_obs_trips, n_obs_hauls, n_obs_ves BETWEEN 1 AND 2 AS small_cell,
  {rounded(MOMENTS + ['total_ft_expf', 'mean_ft_expf', 'se_ft_expf', 'pct_cvg'] + RATIO_COLS + ['expand_byc', 'expand_byc_upper'])},
  round(CASE WHEN lo < total_byc THEN total_byc ELSE lo END, 6) AS expand_byc_lower
FROM bounds"""

REQUEST_VIEWS = """,
hit AS (SELECT DISTINCT sector FROM ob WHERE species = 'PROMO'),
ob_r AS (SELECT * FROM ob WHERE sector <> 'AFRICA' AND sector IN (SELECT sector FROM hit)),
fleet_r AS (SELECT * FROM fleet WHERE sector <> 'AFRICA' AND sector IN (SELECT sector FROM hit))"""

COUNT_AD = """, ad AS (
  SELECT *, ceil(CASE WHEN (species = 'PROMO' OR spid_eqv = 'PROM') AND catch_disposition = 'D' THEN exp_sp_ct ELSE 0 END) AS promo_count
  FROM ob WHERE datatype = 'Analysis Data')"""


def settled(sql):
    """Every ``round(x, d)`` taken as ``round(round(x, d + 4), d)``.

    That is the rounding rule of the reports: noise in the last digits of a sum must not decide ties.
    """
    out, start = "", sql.find("round(")
    while start >= 0:
        depth, end = 1, start + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        value, digits = sql[start + len("round("):end - 1].rsplit(",", 1)
        out += sql[:start] + f"round(round({value}, {int(digits) + 4}), {digits.strip()})"
        sql = sql[end:]
        start = sql.find("round(")
    return out + sql


RECONCILE = f"""{BASE}{AD}, {ratio_ctes(SYG, 'tgt_mt', 'dis_mt', ['PROMO', 'SMALL'], src='ad')},
v AS (SELECT {q(SYG)}, drvid, sum(tgt_mt) AS e FROM ad GROUP BY {q(SYG)}, drvid HAVING sum(tgt_mt) > 0),
vb AS (
  SELECT {q(SYG, 'v.')}, d.species, sum(v.e) AS e,
    sum((SELECT coalesce(sum(dis_mt), 0) FROM ad a WHERE {same('a', 'v', SYG + ['drvid'])} AND a.species = d.species)) AS b
  FROM v CROSS JOIN (VALUES ('PROMO'), ('SMALL')) d(species) GROUP BY {q(SYG, 'v.')}, d.species
),
j AS (
  SELECT {merged('r', 'vb', SYG + ['species'])}, r.species IS NOT NULL AS in_left, vb.species IS NOT NULL AS in_right,
    r.total_byc AS l1, vb.b AS r1, r.byc_ratio AS l2, vb.b / nullif(vb.e, 0) AS r2
  FROM ratios r FULL JOIN vb ON {same('r', 'vb', SYG + ['species'])}
),
u AS (
  SELECT {q(SYG)}, species, in_left, in_right, 'total_byc' AS measure, l1 AS left_value, r1 AS right_value FROM j
  UNION ALL
  SELECT {q(SYG)}, species, in_left, in_right, 'byc_ratio', l2, r2 FROM j
)
SELECT {q(SYG)}, species, in_left, in_right, measure, round(left_value, 6) AS left_value, round(right_value, 6) AS right_value,
  in_left AND in_right AND coalesce(abs(left_value - right_value) <= 1e-4, left_value IS NULL AND right_value IS NULL) AS agrees
FROM u"""

PLAIN = {
    "ratio_est_single": SINGLE,
    "ratio_multi": ratio_sql(SYG, "tgt_mt", "dis_mt", ["PROMO", "SMALL"]),
    "ratio_from_files": f"""{BASE}, ob_y AS (SELECT * FROM ob WHERE "year" BETWEEN 1995 AND 1997),
{ratio_ctes(SYG, 'tgt_mt', 'dis_mt', ['PROMO', 'SMALL'], src='ob_y')}
SELECT {q(SYG)}, species, {rounded(MOMENTS + RATIO_COLS)}, {q(COUNTS)} FROM ratios""",
    "fleet_of_one_year": f"""{BASE}
SELECT {q(SYG)}, round(sum(tgt_mt), 6) AS fleet_expf FROM fleet WHERE "year" = 1997 GROUP BY {q(SYG)}""",
    "ratio_multi_groups": ratio_sql(["year", "gear"], "gfr_mt", "dis_mt", ["PROMO", "LARGE"], "grouping"),
    "expand_multi_raw": f"""{BASE}, {expand_ctes(SYG, 'tgt_mt', 'dis_mt', ['PROMO', 'SMALL'])}
SELECT {q(SYG)}, species, {rounded(['fleet_expf'] + MOMENTS + RATIO_COLS + ['est_byc', 'est_byc_lower', 'est_byc_upper'])},
  {q(COUNTS)}, pct_cvg FROM expanded""",
    "expand_multi_clean": clean_sql(["year", "gear", "sector", "state"], ["PROMO", "SMALL"]),
    "expand_multi_groups": clean_sql(SYG, ["PROMO", "SMALL"], "grouping"),
    "species_request": clean_sql(
        ["year", "gear", "sector", "state"], ["PROMO"], src="ob_r", fleet="fleet_r", extra=REQUEST_VIEWS
    ),
    "boot_ratio": boot_ratio_sql(SY, "dis_mt", ["PROMO", "SMALL"], 10_000),
    "boot_expand": boot_expand_sql(["year", "state", "season"], "promo_count", ["PROMO"], 10_000, COUNT_AD),
    "boot_expand_unobserved": boot_expand_sql(SY, "dis_mt", ["PROMO", "SMALL"], 10_000),
    "boot_pooled": boot_ratio_sql(["sector"], "dis_mt", ["PROMO", "SMALL"], 10_000, SY),
    "boot_chunks": boot_ratio_sql(SY, "dis_mt", ["PROMO", "SMALL"], 10_000),
    "boot_tree": boot_ratio_sql(SY, "dis_mt", ["PROMO", "SMALL"], 10_000, node=8),
    "boot_forty": re.sub(r"\bspecies\b", "kind", boot_ratio_sql(["year"], "dis_mt", FORTY, 1_000, ad=KINDS)).replace(
        "kind || ' ' || sector AS kind", "species || ' ' || sector AS kind").replace("p_type AS kind", "p_type AS species"),
    "boot_pooled_expand": boot_expand_sql(["sector"], "dis_mt", ["PROMO", "SMALL"], 10_000, unit_strata=SY),
    "boot_complete_domains": boot_expand_sql(SY, "dis_mt", ["PROMO", "SMALL"], 10_000, complete=True),
    "boot_at_sea": boot_ratio_sql(SY, "dis_mt", ["PROMO", "SMALL"], 10_000, ad=AT_SEA),
    "request_six_species": f"""{BASE}, {expand_ctes(['sector'], 'tgt_mt', 'exp_sp_ct', SPECIES)}
SELECT sector, species, {rounded(['fleet_expf'] + MOMENTS + RATIO_COLS + ['est_byc', 'est_byc_lower', 'est_byc_upper'])},
  {q(COUNTS)}, pct_cvg FROM expanded""",
    "sector_request": clean_sql(["sector", "year", "state"], ["PROMO", "SMALL"], "grouping", "ob_s", "fleet_s", """,
ob_s AS (SELECT * FROM ob WHERE sector IN ('ASIA', 'EUROPE')), fleet_s AS (SELECT * FROM fleet WHERE sector IN ('ASIA', 'EUROPE'))"""),
    "unsampled_all_species": unsampled_sql(domains=[(s, s == "SMALL") for s in SPECIES]),
    "unsampled_ignore_missing": unsampled_sql(total=lenient),
    "vessel_rollup_forty": f"""{BASE},
o AS (SELECT *, species || ' ' || sector AS kind FROM ob),
e AS (SELECT "year", drvid, sum(gfr_mt) AS ves_expf FROM o GROUP BY "year", drvid),
b AS (SELECT "year", drvid, kind, sum(dis_mt) AS b FROM o GROUP BY "year", drvid, kind),
k AS (
  SELECT s || ' ' || r AS kind FROM (VALUES {values(SPECIES)}) a(s) CROSS JOIN (VALUES {values(SECTORS)}) c(r)
  UNION ALL SELECT 'NEVER ' || i FROM (SELECT unnest(range(0, 10)) AS i)
)
SELECT e."year", e.drvid, k.kind, round(e.ves_expf, 6) AS ves_expf, round(coalesce(b.b, 0), 6) AS ves_byc
FROM e CROSS JOIN k LEFT JOIN b ON {same('e', 'b', ['year', 'drvid'])} AND b.kind = k.kind""",
    "vessel_ticket_matches": f"""{BASE}{AD},
seen AS (
  SELECT {q(SY)}, drvid, 'PROMO' AS species, sum(gfr_mt) AS ves_expf,
    sum(CASE WHEN species = 'PROMO' THEN dis_mt ELSE 0 END) AS ves_byc FROM ad GROUP BY {q(SY)}, drvid
),
land AS (
  SELECT {q(SY)}, drvid, sum(gfr_mt) AS v, sum(sum(gfr_mt)) OVER (PARTITION BY {q(SY)}) AS t
  FROM fleet WHERE drvid % 3 <> 0 GROUP BY {q(SY)}, drvid
)
SELECT {q(SY, 's.')}, s.drvid, s.species, round(ves_expf, 6) AS ves_expf, round(ves_byc, 6) AS ves_byc,
  round(l.v, 6) AS ves_fleet_expf, round(l.t, 6) AS fleet_expf
FROM seen s JOIN land l ON {same('s', 'l', SY + ['drvid'])} WHERE ves_expf > 0""",
    "result_round_trip": f"""{BASE}
SELECT {q(SYG)}, round(sum(tgt_mt), 6) AS fleet_expf FROM fleet GROUP BY {q(SYG)}""",
    # ratios with seven digits are frequent among so many: their ties round half up in decimals, as a double need not
    "boot_replicates": f"""{BASE}{AD}, {boot_ctes(SY, 'dis_mt', ['PROMO', 'SMALL'], 10_000)}
SELECT {q(SY)}, species, CAST(rep AS INTEGER) AS rep, CAST(round(CAST(round(ratio, 10) AS DECIMAL(38, 10)), 6) AS DOUBLE) AS ratio FROM reps""",
    "unsampled_expansion": unsampled_sql(),
    "ratio_se": f"""{BASE},
h AS (SELECT {q(SYG)}, {q(UNITS)}, sum(dis_mt) AS b, sum(tgt_mt) AS e FROM ob GROUP BY {q(SYG)}, {q(UNITS)}),
m AS (SELECT {q(SYG)}, avg(b) AS mean_byc, avg(e) AS mean_expf, sqrt(var_samp(b) / count(*)) AS se_byc,
        sqrt(var_samp(e) / count(*)) AS se_expf FROM h GROUP BY {q(SYG)})
SELECT {q(SYG)}, {rounded(['mean_byc', 'mean_expf', 'se_byc', 'se_expf'])},
  round({se_of_ratio('mean_byc', 'mean_expf', 'se_byc', 'se_expf')}, 6) AS byc_se FROM m""",
    "fleet_effort": f"""{BASE}
SELECT {q(SYG)}, round(sum(tgt_mt), 6) AS fleet_expf, round(sum(tgt_mt), 6) AS total_ft_expf,
  round(avg(tgt_mt), 6) AS mean_ft_expf, round(sqrt(var_samp(tgt_mt) / count(*)), 6) AS se_ft_expf
FROM fleet GROUP BY {q(SYG)}""",
    "observed_effort": f"""{BASE}, {effort_ctes(SYG, 'gfr_mt')}
SELECT {q(SYG)}, {rounded(MOMENTS[:3])}, {q(COUNTS[:3])} FROM eff""",
    "zero_filled_bycatch": f"""{BASE}, {bycatch_ctes(SY, 'dis_mt', ['PROMO', 'SMALL', 'NEVER SEEN'])}
SELECT {q(SY)}, species, {rounded(MOMENTS[3:])}, n_hauls_byc FROM byc""",
    "vessel_rollup": f"""{BASE},
e AS (SELECT {q(SY)}, drvid, sum(gfr_mt) AS ves_expf FROM ob GROUP BY {q(SY)}, drvid),
b AS (SELECT {q(SY)}, drvid, species, sum(dis_mt) AS b FROM ob GROUP BY {q(SY)}, drvid, species)
SELECT {q(SY, 'e.')}, e.drvid, v.species, round(e.ves_expf, 6) AS ves_expf, round(coalesce(b.b, 0), 6) AS ves_byc
FROM e CROSS JOIN (VALUES ('PROMO'), ('SMALL')) v(species)
LEFT JOIN b ON {same('e', 'b', SY + ['drvid'])} AND b.species = v.species""",
    "program_normalise": f"""{BASE}
SELECT CASE WHEN sector = 'ASIA' THEN 'MOTHERSHIP' ELSE sector END AS sector, 'at_sea' AS program, count(*) AS n_rows,
  CAST(0 AS BIGINT) AS n_with_trip, round(sum(pwht_mt), 6) AS tgt_mt FROM ob GROUP BY sector
UNION ALL
SELECT sector, 'shore', count(*), count(trip_id), round(sum(tgt_mt), 6) FROM ob
WHERE datatype = 'Analysis Data' GROUP BY sector""",
    "clean_names": """SELECT o_orderkey AS order_key, o_totalprice AS total_price, o_orderstatus AS order_status,
  o_orderpriority AS percent_priority, o_custkey AS order_key_2 FROM orders""",
    "derive_strata": f"""{BASE}
SELECT state, season, 'CS - ' || gear AS cs_sector, count(*) AS n_rows, round(sum(tgt_mt), 6) AS tgt_mt
FROM ob GROUP BY state, season, gear
UNION ALL
SELECT CASE agency_code WHEN 'C' THEN 'CA' WHEN 'O' THEN 'OR' WHEN 'W' THEN 'WA' END,
  CASE WHEN landing_month IN (5, 6, 7, 8, 9, 10) THEN 'summer' ELSE 'winter' END, NULL, count(*), round(sum(tgt_mt), 6)
FROM fleet GROUP BY 1, 2""",
    "indicator_measure": f"""{BASE}
SELECT {q(SY)},
  sum(ceil(CASE WHEN (species IN ('PROMO', 'SMALL') OR spid_eqv = 'LARG') AND catch_disposition = 'D' THEN exp_sp_wt ELSE 0 END)) AS whole_lb,
  round(sum(CASE WHEN species = 'MEDIUM' THEN exp_sp_wt ELSE 0 END), 6) AS any_lb
FROM ob GROUP BY {q(SY)}""",
    "clamp_bounds": f"""{BASE}, {expand_ctes(SYG, 'tgt_mt', 'dis_mt', ['PROMO', 'SMALL'])}
SELECT {q(SYG)}, species, {rounded(['total_byc', 'est_byc_lower'])},
  round(CASE WHEN est_byc_lower < total_byc THEN total_byc WHEN total_byc IS NOT NULL THEN est_byc_lower END, 6) AS clamped
FROM expanded""",
    "sector_filter": f"""{BASE}
SELECT sector, gear, count(*) AS n_rows, round(sum(dis_mt), 6) AS dis_mt FROM ob
WHERE sector IN ('ASIA', 'EUROPE') GROUP BY sector, gear""",
    "vessel_ticket_join": f"""{BASE}{AD},
seen AS (
  SELECT {q(SY)}, drvid, 'PROMO' AS species, sum(gfr_mt) AS ves_expf,
    sum(CASE WHEN species = 'PROMO' THEN dis_mt ELSE 0 END) AS ves_byc FROM ad GROUP BY {q(SY)}, drvid
),
land AS (
  SELECT {q(SY)}, drvid, sum(gfr_mt) AS v, sum(sum(gfr_mt)) OVER (PARTITION BY {q(SY)}) AS t FROM fleet GROUP BY {q(SY)}, drvid
)
SELECT {q(SY, 's.')}, s.drvid, s.species, round(ves_expf, 6) AS ves_expf, round(ves_byc, 6) AS ves_byc,
  round(l.v, 6) AS ves_fleet_expf, round(l.t, 6) AS fleet_expf
FROM seen s LEFT JOIN land l ON {same('s', 'l', SY + ['drvid'])} WHERE ves_expf > 0""",
    "nifq_haul_set": f"""{BASE},
n AS (SELECT DISTINCT haul_id FROM ob WHERE {NIFQ_RECORD})
SELECT haul_id, 'SMALL' AS species FROM n
UNION ALL
SELECT haul_id, 'PROMO' FROM n WHERE NOT EXISTS (
  SELECT 1 FROM ob o WHERE o.haul_id IS NOT DISTINCT FROM n.haul_id AND o.species = 'PROMO' AND o.catch_disposition = 'D')""",
    "failed_trips": f"{BASE} SELECT DISTINCT trip_id FROM ob WHERE datatype = 'Failed Data'",
    "sectors_with_species": f"""{BASE},
s AS (SELECT DISTINCT sector, gear FROM ob WHERE common_name = 'Unsorted catch not sampled'),
t AS (SELECT sector, sum(tgt_mt) AS tgt_mt FROM fleet GROUP BY sector)
SELECT s.sector, s.gear, round(t.tgt_mt, 6) AS tgt_mt FROM s LEFT JOIN t ON s.sector = t.sector""",
    "strict_sum": f"""{BASE}
SELECT "year", drvid, round({strict('mt', 'ifq = 0')}, 6) AS mt_not_ifq, round(sum(mt), 6) AS mt
FROM ob GROUP BY "year", drvid""",
    "standard_error": f"""{BASE},
h AS (SELECT {q(SYG)}, {q(UNITS)}, sum(mt) AS m FROM ob GROUP BY {q(SYG)}, {q(UNITS)})
SELECT {q(SYG)}, round(avg(m), 6) AS mean_mt, round(sqrt(var_samp(m) / count(*)), 6) AS se_mt FROM h GROUP BY {q(SYG)}""",
    "sample_sizes": f"""{BASE}
SELECT {q(SYG)}, {distinct('drvid')} AS n_obs_ves, {distinct('trip_id')} AS n_obs_trips,
  {distinct('haul_id')} AS n_obs_hauls FROM ob GROUP BY {q(SYG)}""",
    "record_class_counts": f"{BASE} SELECT datatype, count(*) AS n FROM ob GROUP BY datatype",
    "small_cells": f"""{BASE}, {effort_ctes(SYG + ['state', 'season'], 'tgt_mt')}
SELECT {q(SYG + ['state', 'season'])}, n_obs_ves, n_obs_ves > 0 AND n_obs_ves < 3 AS small_cell FROM eff""",
    "key_quality": f"""{BASE}
SELECT count(*) AS n_rows, count(*) - count(haul_id) AS n_missing_haul_id, count(*) - count(trip_id) AS n_missing_trip_id,
  count(*) - count(drvid) AS n_missing_drvid FROM ob""",
    "partition_total": f"""{BASE}
SELECT {q(SY)}, drvid, round(sum(gfr_mt), 6) AS ves_total,
  round(sum(sum(gfr_mt)) OVER (PARTITION BY {q(SY)}), 6) AS stratum_total
FROM fleet GROUP BY {q(SY)}, drvid""",
    "union_domains": f"""{BASE}{AD},
h AS (
  SELECT d.species AS sp, {q(SYG)}, {q(UNITS)}, sum(CASE WHEN a.species = d.species THEN dis_mt ELSE 0 END) AS b, sum(tgt_mt) AS e
  FROM ad a CROSS JOIN (VALUES ('PROMO'), ('SMALL')) d(species) GROUP BY d.species, {q(SYG)}, {q(UNITS)}
)
SELECT sp AS species, {q(SYG)}, round(sum(b), 6) AS total_byc, round(sum(e), 6) AS total_expf, round(avg(b), 6) AS mean_byc,
  round(sum(b) / nullif(sum(e), 0), 6) AS byc_ratio FROM h GROUP BY sp, {q(SYG)}""",
    "distinct_units": f"{BASE} SELECT DISTINCT {q(SYG)}, {q(UNITS)} FROM ob WHERE haul_id IS NOT NULL",
    "round_and_percent": f"""{BASE},
s AS (SELECT {q(SYG)}, sum(dis_mt) / nullif(sum(mt), 0) * 100 AS p FROM ob GROUP BY {q(SYG)})
SELECT {q(SYG)}, {', '.join(f'round(p, {d}) AS pct_{d}' for d in (1, 2, 3, 5, 6))} FROM s""",
    "label_repair": f"""{BASE}
SELECT replace("grouping", '<b0>', '°') AS "grouping", round(sum(dis_mt), 6) AS dis_mt FROM ob GROUP BY 1""",
    "ticket_match_rate": f"""{BASE},
t AS (SELECT DISTINCT unnest(string_split(fish_tickets, ';')) AS ftid FROM ob WHERE fish_tickets <> ''),
m AS (SELECT t.ftid, l.ftid IS NOT NULL AS hit FROM t LEFT JOIN (SELECT DISTINCT 'T' || l_orderkey AS ftid FROM lineitem) l USING (ftid))
SELECT count(*) AS n_tickets, count(*) FILTER (hit) AS n_matched, round(count(*) FILTER (hit) / count(*), 6) AS match_rate FROM m""",
    "coverage": f"""{BASE}, {effort_ctes(SYG, 'tgt_mt')},
l AS (SELECT {q(SYG)}, sum(tgt_mt) AS fleet_expf FROM fleet GROUP BY {q(SYG)})
SELECT {merged('l', 'e', SYG)}, round(l.fleet_expf, 6) AS fleet_expf, round(e.total_expf, 6) AS total_expf,
  round(e.total_expf / nullif(l.fleet_expf, 0) * 100, 2) AS pct_cvg FROM l FULL JOIN eff e ON {same('l', 'e', SYG)}""",
    "unobserved_strata": f"""{BASE}, {effort_ctes(SYG, 'tgt_mt')},
l AS (SELECT DISTINCT {q(SYG)} FROM fleet)
SELECT {q(SYG, 'l.')}, EXISTS (SELECT 1 FROM ob o WHERE {same('o', 'l', SYG)} AND o.datatype = 'Analysis Data'
    AND o.haul_id IS NOT NULL) AS has_sample
FROM l LEFT JOIN eff e ON {same('l', 'e', SYG)} WHERE e.n_obs_ves IS NULL""",
    "cell_range": f"""{BASE}, {effort_ctes(SYG + ['state', 'season'], 'tgt_mt')}
SELECT min(n_obs_ves) AS min_count, max(n_obs_ves) AS max_count FROM eff""",
    "row_counts": f"""{BASE}, {effort_ctes(SYG, 'tgt_mt')}
SELECT a AS n_left, b AS n_right, a = b AS equal FROM (
  SELECT (SELECT count(*) FROM eff) AS a, (SELECT count(*) FROM (SELECT DISTINCT {q(SYG)} FROM fleet)) AS b)""",
    "component_totals": unsampled_sql("""SELECT "year", r_state, bycsp,
  round(coalesce(est_nifq_ct, 0) + coalesce(est_zmis_ct, 0) + coalesce(est_unst_ct, 0) + coalesce(est_fail_ct, 0), 6) AS est_ct,
  round(coalesce(obs_byc_ct, 0), 6) AS obs_byc_ct FROM est"""),
    "numeric_year": f"""{BASE}
SELECT CAST("year" AS DOUBLE) AS "year", count(*) AS n_rows, round(sum(mt), 6) AS mt FROM ob GROUP BY "year" """,
    "reconcile": RECONCILE,
    "reconcile_mismatches": f"SELECT * FROM ({RECONCILE}) WHERE NOT agrees",
}

ORACLE = {name: settled(sql) for name, sql in PLAIN.items()}
