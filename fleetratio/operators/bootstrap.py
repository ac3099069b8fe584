"""Vessel-level bootstrap of bycatch ratios.

Ordinary resampling: a stratum with n vessels is redrawn n times with replacement, R times. The
draw is a hash of (seed, stratum, replicate, draw number), so the result does not depend on
partitioning, retries or the order of rows, and no state is kept between tasks. Vessels are numbered
by the order of a hash of their key, by the same rule in a stratum of any size.

The numbers form a tree of fixed nodes. The n draws of a replicate are first dealt to nodes by one
hash each; a node then draws only its share among its own vessels. So a replicate takes at most two
hashes a draw, however many nodes, chunks and tasks a stratum is cut into. Spark deals rows of work
out; inside a row of work draws are counted in arrays (``functions.draws``), no row is made for a draw.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import DRAWS_PER_HASH, count_draws
from ..functions.names import column_list, domain_list, require_columns
from ..functions.nulls import divide, measure, null_safe_join, sum_or_zero
from ..functions.stats import clamp_lower, percent
from ..sources.checkpoints import cut_lineage
from .expand import spread_domains
from .moments import UNIT_COLS, fleet_effort, stratum_domain_moments
from .prepare import program_normalise
from .quantiles import exact_quantiles

SAMPLERS = ("xxhash64", "md5")
# Consecutive vessels of a node of the tree; a part of the sampling rule, as the seed is.
NODE_UNITS = 4096
# Draws dealt to nodes by one row of work.
DEAL_DRAWS = 1_000_000
# Replicates of a stratum in one row of work; the work of one stratum spreads over R / this.
REPLICATE_BLOCK = 250
# Vessels of a row of work: as many whole nodes as come to them, or a part of a larger node.
PIECE_UNITS = 4096
# Counts of draws that a row of work holds at once while it deals draws to nodes.
DEAL_CELLS = 1_000_000
# Hex digits of a vessel's hash that name its bucket, the same for every stratum.
BUCKET_DIGITS = 3


def vessel_sums(
    ob: DataFrame,
    strata: Sequence[str],
    domains: Sequence[str],
    effort: str,
    unit: str,
    domain_col: str,
    vessel_col: str,
) -> DataFrame:
    """Effort and bycatch per stratum and vessel, in one scan.

    ``__entries`` holds (0, effort) and (place in the list, bycatch) of each domain that the vessel caught:
    a domain that does not occur costs nothing. Records are summed by domain before they are packed.
    """
    require_columns(ob, [*strata, vessel_col, effort, unit, domain_col], "observer table")
    keys, value, load = [*strata, vessel_col], measure(unit), measure(effort)
    place = F.when(F.col(domain_col).isin(list(domains)), F.array_position(_names(domains), F.col(domain_col)).cast("int"))
    by_domain = (
        ob.withColumn("__place", place)
        .groupBy(*keys, "__place")
        .agg(sum_or_zero(load).alias("__load"), sum_or_zero(value).alias("__value"))
    )
    entry = F.when(F.col("__place").isNotNull() & (F.col("__value") != 0), _entry(F.col("__place"), F.col("__value")))
    packed = by_domain.groupBy(*keys).agg(F.sum("__load").alias("ves_expf"), F.collect_list(entry).alias("__caught"))
    entries = F.concat(F.array(_entry(F.lit(0), F.col("ves_expf"))), F.col("__caught"))
    return packed.select(*keys, "ves_expf", entries.alias("__entries"))


def _entry(place: Column, amount: Column) -> Column:
    return F.struct(place.alias("k"), amount.alias("v"))


def _names(domains: Sequence[str]) -> Column:
    return F.array(*[F.lit(d) for d in domains])


def _by_domain(df: DataFrame, domains: Sequence[str], domain_col: str, name: str, amount: Column) -> DataFrame:
    """One row per domain; ``amount`` reads the map ``__m`` at ``__k``, the domain's place."""
    keep = [c for c in df.columns if c != "__m"]
    spread = df.select(*keep, "__m", F.posexplode(_names(domains)).alias("__at", domain_col)).withColumn("__k", F.col("__at") + 1)
    return spread.select(*keep, domain_col, amount.alias(name))


def _amount() -> Column:
    return F.coalesce(F.try_element_at("__m", F.col("__k")), F.lit(0.0))


def vessel_rollup(
    ob: DataFrame,
    strata: Sequence[str] | str,
    domains: Sequence[str] | str,
    effort: str = "tgt_mt",
    unit: str = "dis_mt",
    domain_col: str = "species",
    vessel_col: str = UNIT_COLS[2],
) -> DataFrame:
    """Effort and bycatch per stratum, vessel and domain; vessels without the domain have 0."""
    strata, domains = column_list(strata), domain_list(domains)
    sums = vessel_sums(ob, strata, domains, effort, unit, domain_col, vessel_col)
    mapped = sums.select(*strata, vessel_col, "ves_expf", F.map_from_entries("__entries").alias("__m"))
    return _by_domain(mapped, domains, domain_col, "ves_byc", _amount())


def key_text(columns: Sequence[str]) -> Column:
    """One text for the values of some columns; missing values and separators in a value stay distinct."""

    def part(name: str) -> Column:
        escaped = F.replace(F.replace(F.col(name).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.coalesce(F.concat(F.lit("V"), escaped), F.lit("N"))

    return F.concat_ws("|", *[part(c) for c in columns])


def _hash_start(sampler: str, seed: int) -> Column:
    """What all hashes of a stratum begin with: the text before the node, or the hash of seed and stratum."""
    if sampler == "md5":
        return F.concat(F.lit(f"{seed}|"), F.col("__salt"), F.lit("|"))
    return F.xxhash64(F.lit(int(seed)).cast("bigint"), F.col("__salt"))


def _numbered_units(units: DataFrame, strata: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Number the vessels of each stratum 0 .. n-1 (``__idx``) and add n (``__n``).

    The order is that of the md5 of the vessel's key, then the key. Vessels are numbered inside
    buckets of that hash and shifted by the sizes of the buckets before, so no task sees a whole
    stratum and the number depends on nothing but the stratum's vessels.
    """
    hashed = units.withColumn("__md5", F.md5(key_text(order))).withColumn("__bucket", F.substring("__md5", 1, BUCKET_DIGITS))
    whole = Window.partitionBy(*strata)
    before = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most 16^3 rows of a stratum
    offsets = (
        hashed.groupBy(*strata, "__bucket")
        .agg(F.count(F.lit(1)).alias("__count"))
        .select(
            *strata,
            "__bucket",
            F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__offset"),
            F.sum("__count").over(whole).alias("__n"),
        )
    )
    place = F.row_number().over(Window.partitionBy(*strata, "__bucket").orderBy("__md5", *order))
    numbered = hashed.withColumn("__place", place)
    return null_safe_join(numbered, offsets, [*strata, "__bucket"], "inner").withColumn(
        "__idx", F.col("__offset") + F.col("__place") - 1
    )


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _node_shares(sizes: DataFrame, replicates, block, seed, sampler, node_units) -> DataFrame:
    """Draws that each node of a stratum of several nodes gets in each replicate (``__shares``), by block of replicates.

    Each of the n draws is dealt by its own hash, in rows of work of a million draws a replicate. A node has one row
    for each part of the draws and some replicates of the block.
    """
    blocks = F.sequence(F.lit(0), F.lit(ceil(replicates / block) - 1))
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / DEAL_DRAWS))
    work = (
        sizes.where(F.col("__n") > node_units)
        .select("__salt", _hash_start(sampler, seed).alias("__start"), "__n", F.explode(blocks).alias("__block"))
        .withColumn("__part", F.explode(parts))
        .repartition(_tasks(sizes), "__salt", "__block", "__part")
    )
    deal_draws, deal_cells = DEAL_DRAWS, DEAL_CELLS

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n, first = row["__n"], row["__part"] * deal_draws
                nodes = -(-n // node_units)
                last = min(row["__block"] * block + block, replicates)
                step = max(1, deal_cells // nodes)
                for low in range(row["__block"] * block + 1, last + 1, step):
                    reps = np.arange(low, min(low + step, last + 1))
                    start, columns = row["__start"], [reps]
                    if sampler == "md5":
                        start += "-1|"
                    else:
                        columns = [np.full(len(reps), -1), reps]
                    counts = count_draws(
                        sampler, start, columns, np.full(len(reps), min(deal_draws, n - first)), np.full(len(reps), n),
                        np.arange(len(reps)) * nodes, len(reps) * nodes, first, node_units,
                    )
                    by_node = counts.reshape(len(reps), nodes).T
                    node, rep = np.nonzero(by_node)
                    offsets = np.searchsorted(node, np.arange(nodes + 1)).astype(np.int32)
                    shares = pa.MapArray.from_arrays(offsets, pa.array(reps[rep].astype(np.int32)), pa.array(by_node[node, rep]))
                    some = offsets[1:] > offsets[:-1]
                    columns = [
                        pa.array([row["__salt"]] * nodes, pa.string()),
                        pa.array(np.arange(nodes)),
                        pa.array(np.full(nodes, row["__block"], np.int32)),
                        shares,
                    ]
                    names = ["__salt", "__node", "__block", "__shares"]
                    yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(some))

    return work.mapInArrow(deal, "__salt string, __node bigint, __block int, __shares map<int,int>")


def _replicate_sums(units, strata, order, replicates, seed, sampler, chunk_units, node_units, tasks=None) -> DataFrame:
    """(strata, rep, __m): sums by place of each stratum and replicate, effort at place 0, whatever the stratum's size.

    Vessels travel in chunks, an array of their entries each. A row of work is a block of replicates of a piece of a
    stratum: the chunks of some nodes, or of a part of a large one. It counts how often each vessel of the piece is
    drawn, once for all its chunks, and sums the entries in place; only sums are shuffled. Places that no drawn
    vessel has may be missing.
    """
    chunk_units = min(chunk_units, node_units)
    span_nodes = max(1, PIECE_UNITS // node_units)
    span_units = span_nodes * node_units
    piece_units = span_units if node_units <= PIECE_UNITS else chunk_units * ceil(PIECE_UNITS / chunk_units)
    block = max(1, min(REPLICATE_BLOCK, ceil(replicates / 8)))
    tasks = tasks or _tasks(units)
    work_keys = ["__salt", "__node", "__chunk", "__block"]

    numbered = _numbered_units(units, strata, order).withColumn("__salt", key_text(strata))
    chunked = numbered.select(
        *strata,
        "__salt",
        "__n",
        F.expr(f"__idx div {span_units} * {span_nodes}").alias("__node"),
        F.expr(f"__idx % {span_units} div {piece_units}").alias("__chunk"),
        F.expr(f"__idx - __idx % {node_units} % {chunk_units}").alias("__first"),
        F.col("__idx").alias("__at"),
        "__entries",
    )
    in_order = F.sort_array(F.collect_list(F.struct("__at", "__entries")))
    packed = chunked.groupBy(*strata, "__salt", "__n", "__node", "__chunk", "__first").agg(in_order.getField("__entries").alias("__units"))
    work = packed.withColumn("__start", _hash_start(sampler, seed))
    work = work.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(ceil(replicates / block) - 1))))
    work = work.repartition(tasks, *work_keys)

    sizes = numbered.select("__salt", "__n").distinct()
    pieces = F.sequence(F.lit(0).cast("bigint"), F.lit(ceil(span_units / piece_units) - 1).cast("bigint"))
    shares = _node_shares(sizes, replicates, block, seed, sampler, node_units)
    shares = shares.select(
        "__salt", F.expr(f"__node - __node % {span_nodes}").alias("__node"), F.explode(pieces).alias("__chunk"), "__block",
        F.col("__node").alias("__own"), "__shares",
    ).repartition(tasks, *work_keys)

    schema = work.select(*strata, F.lit(0).alias("rep"), F.lit(0).alias("k"), F.lit(0.0).alias("v")).schema
    width = len(strata)

    def piece_sums(chunks, dealt):
        if not chunks.num_rows:
            return pa.table({})
        row = chunks.select(["__n", "__node", "__chunk", "__block", "__start"]).slice(0, 1).to_pylist()[0]
        n, node0, low = row["__n"], row["__node"], row["__node"] * node_units + row["__chunk"] * piece_units
        held = min(piece_units, n - low)
        reps = np.arange(row["__block"] * block + 1, min(row["__block"] * block + block, replicates) + 1)
        nodes = np.arange(node0, min(node0 + span_nodes, -(-n // node_units)))
        shared = np.zeros((len(reps), len(nodes)), np.int64)
        if n <= node_units:
            shared[:] = n
        elif dealt.num_rows:
            maps = dealt.column("__shares").combine_chunks()
            lengths = np.diff(maps.offsets.to_numpy(zero_copy_only=False))
            span = slice(maps.offsets[0].as_py(), maps.offsets[-1].as_py())
            own = np.repeat(dealt.column("__own").to_numpy(), lengths) - node0
            at = maps.keys.to_numpy(zero_copy_only=False)[span] - reps[0]
            np.add.at(shared, (at, own), maps.items.to_numpy(zero_copy_only=False)[span])
        rep, node = np.repeat(reps, len(nodes)), np.tile(nodes, len(reps))
        counts = count_draws(
            sampler, row["__start"], [node, rep], shared.ravel(), np.minimum(node_units, n - node * node_units),
            (rep - reps[0]) * held + node * node_units - low, len(reps) * held,
        ) if span_nodes * node_units == piece_units else np.concatenate([
            count_draws(sampler, row["__start"], [nodes, np.full(1, r)], shared[i], np.minimum(node_units, n - nodes * node_units),
                        nodes * node_units - low, held)
            for i, r in enumerate(reps)
        ])
        counts = counts.reshape(len(reps), held)

        listed = chunks.column("__units").combine_chunks()
        lengths = pc.list_value_length(listed).to_numpy()
        entries = listed.flatten()
        begins = np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.repeat(chunks.column("__first").to_numpy() - low, lengths) + np.arange(len(entries)) - begins
        at = np.repeat(at, pc.list_value_length(entries).to_numpy())
        entries = entries.flatten()
        place = pc.struct_field(entries, "k").to_numpy(zero_copy_only=False)
        amount = pc.struct_field(entries, "v").to_numpy(zero_copy_only=False)
        by_place = np.argsort(place, kind="stable")
        places, begins = np.unique(place[by_place], return_index=True)
        rows = []
        for k, some in zip(places, np.split(by_place, begins[1:])):
            drawn, value = counts[:, at[some]].astype(np.float64), amount[some]
            if np.isfinite(value).all():
                sums = drawn @ value
            else:
                sums = np.where(drawn > 0, drawn * value, 0.0).sum(axis=1)
            kept = (drawn > 0).any(axis=1) if k == 0 else sums != 0
            rows.append((reps[kept], np.full(int(kept.sum()), k), sums[kept]))
        rep, k, v = (np.concatenate(c) for c in zip(*rows))
        key = [chunks.column(i).combine_chunks().take(pa.array(np.zeros(len(rep), np.int64))) for i in range(width)]
        names = [*chunks.column_names[:width], "rep", "k", "v"]
        return pa.table([*key, pa.array(rep.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(v)], names)

    in_place = work.groupBy(*work_keys).cogroup(shares.groupBy(*work_keys)).applyInArrow(piece_sums, schema)
    sums = in_place.repartition(*strata, "rep").groupBy(*strata, "rep", "k").agg(F.sum("v").alias("v"))
    return sums.groupBy(*strata, "rep").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("__m"))


def _check_sampling(replicates: int, sampler: str, chunk_units: int, node_units: int) -> None:
    if replicates < 1:
        raise ValueError("replicates must be positive")
    if chunk_units < 1 or node_units < 1:
        raise ValueError("chunk_units and node_units must be positive")
    if sampler not in SAMPLERS:
        raise ValueError(f"unknown sampler {sampler!r}: use one of {', '.join(SAMPLERS)}")


def _resampling_units(ob, strata, unit_strata, domains, effort, unit, domain_col, vessel_col):
    """Vessel rows with positive effort, and the columns that order them in a stratum.

    They are stored in the checkpoint folder where the session has one; else later steps sum them again.
    """
    unit_strata = list(strata) if unit_strata is None else column_list(unit_strata)
    absent = [c for c in strata if c not in unit_strata]
    if absent:
        raise ValueError(f"unit_strata lacks reporting strata: {', '.join(absent)}")
    order = [c for c in unit_strata if c not in strata] + [vessel_col]
    sums = vessel_sums(ob, unit_strata, domains, effort, unit, domain_col, vessel_col)
    return cut_lineage(sums.where(F.col("ves_expf") > 0)), order


def boot_replicates(
    ob: DataFrame,
    strata: Sequence[str] | str,
    domains: Sequence[str] | str,
    unit_strata: Sequence[str] | str | None = None,
    effort: str = "tgt_mt",
    unit: str = "dis_mt",
    domain_col: str = "species",
    vessel_col: str = UNIT_COLS[2],
    replicates: int = 10_000,
    seed: int = 42,
    sampler: str = "xxhash64",
    chunk_units: int = NODE_UNITS,
    node_units: int = NODE_UNITS,
) -> DataFrame:
    """The bootstrapped ratio of every stratum, domain and replicate."""
    strata, domains = column_list(strata), domain_list(domains)
    _check_sampling(replicates, sampler, chunk_units, node_units)
    units, order = _resampling_units(ob, strata, unit_strata, domains, effort, unit, domain_col, vessel_col)
    sums = _replicate_sums(units, strata, order, replicates, seed, sampler, chunk_units, node_units)
    return _by_domain(sums, domains, domain_col, "ratio", divide(_amount(), F.try_element_at("__m", F.lit(0))))


def boot_summary(
    ob: DataFrame,
    strata: Sequence[str] | str,
    domains: Sequence[str] | str,
    unit_strata: Sequence[str] | str | None = None,
    effort: str = "tgt_mt",
    unit: str = "dis_mt",
    domain_col: str = "species",
    vessel_col: str = UNIT_COLS[2],
    replicates: int = 10_000,
    seed: int = 42,
    sampler: str = "xxhash64",
    chunk_units: int = NODE_UNITS,
    node_units: int = NODE_UNITS,
    confidence: float = 0.95,
) -> DataFrame:
    """Point estimate, median, mean and percentile interval of the ratio, by stratum and domain."""
    strata, domains = column_list(strata), domain_list(domains)
    _check_sampling(replicates, sampler, chunk_units, node_units)
    units, order = _resampling_units(ob, strata, unit_strata, domains, effort, unit, domain_col, vessel_col)
    sums = _replicate_sums(units, strata, order, replicates, seed, sampler, chunk_units, node_units)
    # domains that a replicate lacks have no row and count as zero
    ratios = sums.select(*strata, F.try_element_at("__m", F.lit(0)).alias("__e"), F.explode("__m").alias("__k", "__v")).where(F.col("__k") > 0)
    ratios = ratios.select(*strata, "__k", divide(F.col("__v"), F.col("__e")).alias("ratio"))
    tail = round((1 - confidence) / 2, 10)
    stats = exact_quantiles(ratios, [*strata, "__k"], "ratio", [tail, 0.5, 1 - tail], rows_per_group=replicates)
    totals = units.select(*strata, F.inline("__entries")).groupBy(*strata, "k").agg(F.sum("v").alias("v"))
    totals = totals.groupBy(*strata).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("__m"))
    spread = totals.select(*strata, "__m", F.posexplode(_names(domains)).alias("__at", domain_col)).withColumn("__k", F.col("__at") + 1)
    point = spread.select(*strata, "__k", domain_col, divide(_amount(), F.try_element_at("__m", F.lit(0))).alias("point_est_ratio"))
    out = null_safe_join(point, stats, [*strata, "__k"], "left")
    return out.select(
        *strata,
        domain_col,
        "point_est_ratio",
        F.coalesce(F.col("__q")[1], F.lit(0.0)).alias("median_ratio"),
        F.coalesce("__mean", F.lit(0.0)).alias("mean_ratio"),
        F.coalesce(F.col("__q")[0], F.lit(0.0)).alias("lower_ci"),
        F.coalesce(F.col("__q")[2], F.lit(0.0)).alias("upper_ci"),
    )


def bootstrap_ratio(
    ob: DataFrame,
    strata: Sequence[str] | str,
    domains: Sequence[str] | str,
    unit_strata: Sequence[str] | str | None = None,
    effort: str = "tgt_mt",
    unit: str = "dis_mt",
    domain_col: str = "species",
    replicates: int = 10_000,
    seed: int = 42,
    sampler: str = "xxhash64",
    unit_cols: Sequence[str] = UNIT_COLS,
    chunk_units: int = NODE_UNITS,
    node_units: int = NODE_UNITS,
    confidence: float = 0.95,
    *,
    program: str,
) -> DataFrame:
    """Bootstrap interval of the bycatch ratio with the observed summaries, no expansion.

    ``unit_strata`` may be finer than ``strata``: a vessel then counts as one resampling unit per
    finer stratum. Vessel sums include records without a haul id; haul summaries do not.
    """
    strata = column_list(strata)
    data = program_normalise(ob, program)
    boot, observed = _boot_and_observed(
        data, strata, domains, unit_strata, effort, unit, domain_col, replicates, seed, sampler,
        unit_cols, chunk_units, node_units, confidence,
    )
    out = null_safe_join(boot, observed, [*strata, domain_col], "full")
    return _with_observed_ratio(out)


def bootstrap_expand(
    ob: DataFrame,
    fleet: DataFrame,
    strata: Sequence[str] | str,
    domains: Sequence[str] | str,
    unit_strata: Sequence[str] | str | None = None,
    effort: str = "tgt_mt",
    unit: str = "dis_mt",
    domain_col: str = "species",
    replicates: int = 10_000,
    seed: int = 42,
    sampler: str = "xxhash64",
    unit_cols: Sequence[str] = UNIT_COLS,
    chunk_units: int = NODE_UNITS,
    node_units: int = NODE_UNITS,
    confidence: float = 0.95,
    complete_domains: bool = False,
    *,
    program: str,
) -> DataFrame:
    """Bootstrap interval of the bycatch ratio, expanded to the fleet.

    A fleet stratum without bootstrap has one row with a NULL domain; ``complete_domains`` gives
    it one row per domain instead.
    """
    strata = column_list(strata)
    data = program_normalise(ob, program)
    boot, observed = _boot_and_observed(
        data, strata, domains, unit_strata, effort, unit, domain_col, replicates, seed, sampler,
        unit_cols, chunk_units, node_units, confidence,
    )
    totals = fleet_effort(fleet, strata, effort)
    cell = [*strata, domain_col]
    if complete_domains:
        out = null_safe_join(spread_domains(totals, domains, domain_col), boot, cell, "full")
    else:
        out = null_safe_join(totals, boot, strata, "full")
    out = _with_observed_ratio(null_safe_join(out, observed, cell, "full"))
    fleet_total = F.col("fleet_expf")
    return out.withColumns(
        {
            "pct_cvg": percent(F.col("total_expf"), fleet_total, 2),
            "est_byc": F.col("byc_ratio") * fleet_total,
            "est_byc_mean_ratio": F.col("mean_ratio") * fleet_total,
            "est_byc_med_ratio": F.col("median_ratio") * fleet_total,
            "est_byc_lower": F.col("lower_ci") * fleet_total,
            "est_byc_lower_trunc": clamp_lower(F.col("lower_ci") * fleet_total, F.col("total_byc")),
            "est_byc_upper": F.col("upper_ci") * fleet_total,
        }
    )


def _boot_and_observed(
    data, strata, domains, unit_strata, effort, unit, domain_col, replicates, seed, sampler, unit_cols,
    chunk_units, node_units, confidence,
):
    boot = boot_summary(
        data, strata, domains, unit_strata, effort, unit, domain_col, unit_cols[2], replicates, seed,
        sampler, chunk_units, node_units, confidence,
    )
    observed = stratum_domain_moments(
        data, strata, domains, effort, unit, domain_col, unit_cols=unit_cols, effort_filter=False
    )
    return boot, observed


def _with_observed_ratio(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "pct_hauls_byc": percent(F.col("n_hauls_byc"), F.col("n_obs_hauls"), 2),
            "byc_ratio": divide(F.col("total_byc"), F.col("total_expf")),
        }
    )
