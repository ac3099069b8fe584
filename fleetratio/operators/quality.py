"""Checks of inputs and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import column_list, require_columns
from ..functions.nulls import divide, measure, null_safe_join, sum_or_zero
from ..functions.stats import percent
from .bootstrap import vessel_rollup
from .moments import ANALYSIS, UNIT_COLS, fleet_effort, observed_effort

# Parts of a stratum when its total is joined back to its vessels.
STRATUM_SALTS = 64
# Key ranges whose digests two tables are compared by.
DIGEST_RANGES = 4096
# Bits of the set that landing lines are tested against before they are shuffled: 16 MB, whatever the ids.
FILTER_BITS = 2**27


def flag_small_cells(df: DataFrame, count_col: str = "n_obs_ves", minimum: int = 3) -> DataFrame:
    """Add ``small_cell``: strata with observed vessels, but fewer than ``minimum``."""
    return df.withColumn("small_cell", (F.col(count_col) > 0) & (F.col(count_col) < minimum))


def small_cells(df: DataFrame, count_col: str = "n_obs_ves", minimum: int = 3) -> DataFrame:
    """The strata that must not be published as they are."""
    return flag_small_cells(df, count_col, minimum).where("small_cell")


def cell_range(df: DataFrame, count_col: str = "n_obs_ves") -> DataFrame:
    """Least and greatest count over all strata, in one row."""
    return df.agg(F.min(count_col).alias("min_count"), F.max(count_col).alias("max_count"))


def coverage(
    ob: DataFrame,
    fleet: DataFrame,
    strata: Sequence[str] | str,
    effort: str = "tgt_mt",
    unit_cols: Sequence[str] = UNIT_COLS,
) -> DataFrame:
    """Observed effort as a percentage of fleet effort per stratum."""
    strata = column_list(strata)
    seen = observed_effort(ob, strata, effort, unit_cols).select(*strata, "total_expf")
    both = null_safe_join(fleet_effort(fleet, strata, effort), seen, strata, "full")
    return both.withColumn("pct_cvg", percent(F.col("total_expf"), F.col("fleet_expf"), 2))


def key_quality(df: DataFrame, keys: Sequence[str] = UNIT_COLS) -> DataFrame:
    """Number of rows and of missing values per key column, in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(k).isNull()).alias(f"n_missing_{k}") for k in keys],
    )


def record_class_counts(ob: DataFrame, col: str = "datatype") -> DataFrame:
    """Number of records by class."""
    return ob.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def ticket_ids(ob: DataFrame, col: str = "fish_tickets") -> DataFrame:
    """One row per ticket id of the ``;``-separated lists; a closing separator adds none."""
    ids = F.split(F.regexp_replace(F.col(col), ";$", ""), ";")
    return ob.where(F.col(col) != "").select(F.explode(ids).alias("ftid"))


def _id_bit(name: str, bits: int) -> Column:
    """Place of an id in a set of ``bits`` bits, from 1."""
    return F.xxhash64(name).bitwiseAND(F.lit(bits - 1)) + 1


def possible_members(df: DataFrame, ids: DataFrame, col: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``df`` whose ``col`` may be among ``ids``; a row that is left out certainly is not.

    The distinct ``ids`` set bits in pieces of 4 KB that are broadcast: at most ``bits`` / 8 bytes, ``bits`` a power
    of two. The ids move to their piece before it is built, so no half-filled pieces are shuffled. With n ids about
    n / ``bits`` of the other rows pass as well, so a join must follow. Rows without a value are left out.
    """
    if bits < 1 or bits & (bits - 1):
        raise ValueError("bits must be a power of two")
    place = _id_bit(col, bits)
    pieces = (
        ids.select(F.bitmap_bucket_number(place).alias("__piece"), F.bitmap_bit_position(place).alias("__bit"))
        .repartition("__piece")
        .groupBy("__piece")
        .agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    )
    tested = df.where(F.col(col).isNotNull()).withColumn("__place", place)
    joined = tested.join(F.broadcast(pieces), F.bitmap_bucket_number("__place") == F.col("__piece"))
    at = F.bitmap_bit_position("__place")
    byte = F.ascii(F.decode(F.substring("__bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    bit = F.call_function("shiftleft", F.lit(1), at.bitwiseAND(F.lit(7)).cast("int"))
    return joined.where(byte.bitwiseAND(bit) != 0).select(*[F.col(f"`{c}`") for c in df.columns])


def ticket_match_rate(
    ob: DataFrame, fleet: DataFrame, ticket_col: str = "fish_tickets", id_col: str = "ftid", bits: int = FILTER_BITS
) -> DataFrame:
    """Share of distinct observed ticket ids that occur in the fleet table.

    Few landing lines belong to an observed trip: lines are first tested against a bit set of the observed ids,
    and only possible matches are shuffled. Both sides are reduced to one row per id before they meet.
    """
    seen = ticket_ids(ob, ticket_col).distinct()
    lines = fleet.select(F.col(id_col).cast("string").alias("ftid"))
    landed = possible_members(lines, seen, "ftid", bits).distinct().select(F.col("ftid").alias("__landed"))
    ids = seen.join(landed, F.col("ftid") == F.col("__landed"), "left")
    out = ids.agg(F.count(F.lit(1)).alias("n_tickets"), F.count("__landed").alias("n_matched"))
    return out.withColumn("match_rate", divide(F.col("n_matched").cast("double"), F.col("n_tickets").cast("double")))


def partition_total(
    df: DataFrame,
    strata: Sequence[str] | str,
    value: str = "gfr_mt",
    vessel_col: str = UNIT_COLS[2],
    salts: int = STRATUM_SALTS,
) -> DataFrame:
    """Vessel sums with the total of their stratum on every row.

    Totals are aggregated and joined back instead of using a window, which would bring all
    vessels of a stratum into one task. For the join the vessels of a stratum are dealt to
    ``salts`` parts by their id, and the total is repeated for each part.
    """
    strata = column_list(strata)
    if salts < 1:
        raise ValueError("salts must be positive")
    vessels = df.groupBy(*strata, vessel_col).agg(sum_or_zero(measure(value)).alias("ves_total"))
    totals = vessels.groupBy(*strata).agg(F.sum("ves_total").alias("stratum_total"))
    parts = totals.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = vessels.withColumn("__salt", F.pmod(F.xxhash64(vessel_col), F.lit(salts)).cast("int"))
    return null_safe_join(salted, parts, [*strata, "__salt"], "left").drop("__salt")


def vessel_ticket_join(
    ob: DataFrame,
    fleet: DataFrame,
    strata: Sequence[str] | str,
    domain: str,
    effort: str = "gfr_mt",
    unit: str = "dis_mt",
    domain_col: str = "species",
    vessel_col: str = UNIT_COLS[2],
    matched_only: bool = False,
) -> DataFrame:
    """Observed vessels with positive effort and their landed effort; NULL where nothing was landed."""
    strata = column_list(strata)
    seen = vessel_rollup(ob, strata, [domain], effort, unit, domain_col, vessel_col).where(F.col("ves_expf") > 0)
    landed = partition_total(fleet, strata, effort, vessel_col).select(
        *strata, vessel_col, F.col("ves_total").alias("ves_fleet_expf"), F.col("stratum_total").alias("fleet_expf")
    )
    out = null_safe_join(seen, landed, [*strata, vessel_col], "left")
    return out.where(F.col("ves_fleet_expf").isNotNull()) if matched_only else out


def unobserved_strata(result: DataFrame, ob: DataFrame, strata: Sequence[str] | str, haul_col: str = UNIT_COLS[0]) -> DataFrame:
    """Result strata without sample, with ``has_sample`` telling whether sampled records exist after all.

    ``has_sample`` must be false on every row.
    """
    strata = column_list(strata)
    empty = result.where(F.col("n_obs_ves").isNull() | (F.col("n_obs_ves") == 0)).select(*strata).distinct()
    sampled = (
        ob.where((F.col("datatype") == ANALYSIS) & F.col(haul_col).isNotNull())
        .select(*strata)
        .distinct()
        .withColumn("has_sample", F.lit(True))
    )
    out = null_safe_join(empty, sampled, strata, "left")
    return out.withColumn("has_sample", F.coalesce(F.col("has_sample"), F.lit(False)))


def range_digests(
    df: DataFrame, keys: Sequence[str] | str, measures: Sequence[str] | str, ranges: int = DIGEST_RANGES
) -> DataFrame:
    """(range, rows, x, y): an order-free digest of the rows in each range of the keys' hash.

    Rows are hashed by keys and measures; the hashes of a range are combined by exclusive or and by the sum
    of their halves, before anything is shuffled.
    """
    keys, measures = column_list(keys), column_list(measures)
    row = F.xxhash64(F.lit(1), *_hashable(keys), *_hashable(measures, measure))
    hashed = df.select(key_range(keys, ranges).alias("range"), row.alias("__h"))
    return hashed.groupBy("range").agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor("__h").alias("x"),
        F.sum(F.shiftrightunsigned("__h", 32) + F.col("__h").bitwiseAND(F.lit(0xFFFFFFFF)) * 3).alias("y"),
    )


def _hashable(names: Sequence[str], read=F.col) -> list[Column]:
    """Values with their null flags, as a hash passes over nulls; -0.0 counts as 0.0."""
    values = [read(n) + F.lit(0.0) if read is measure else read(n) for n in names]
    return [part for v in values for part in (v, v.isNull())]


def key_range(keys: Sequence[str], ranges: int = DIGEST_RANGES) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), *_hashable(keys)), F.lit(ranges)).cast("int")


def differing_ranges(
    left: DataFrame, right: DataFrame, keys: Sequence[str] | str, measures: Sequence[str] | str, ranges: int = DIGEST_RANGES
) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables in the key ranges whose digests differ; of equal tables only digests are shuffled.

    Key columns must have the same types on both sides, or equal keys hash apart.
    """
    keys, measures = column_list(keys), column_list(measures)
    types = [[df.schema[k].dataType for k in keys] for df in (left, right)]
    if types[0] != types[1]:
        return left, right
    tagged = range_digests(left, keys, measures, ranges).unionByName(range_digests(right, keys, measures, ranges))
    # a range differs if one side lacks it or the two digests are not the same
    same = (F.count(F.lit(1)) == 2) & (F.min("rows") == F.max("rows")) & (F.min("x") == F.max("x")) & (F.min("y") == F.max("y"))
    differ = tagged.groupBy("range").agg(same.alias("__same")).where(~F.col("__same")).select(F.col("range").alias("__range"))

    def opened(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(differ), key_range(keys, ranges) == F.col("__range"), "left_semi")  # at most ``ranges`` rows

    return opened(left), opened(right)


def reconcile(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] | str,
    measures: Sequence[str] | str,
    tolerance: float = 1e-6,
    mismatches_only: bool = False,
) -> DataFrame:
    """Two result tables side by side, one row per key and measure.

    Values agree if both are missing or differ by at most ``tolerance``; a key on one side only
    never agrees. With ``mismatches_only`` the tables are first compared by digests, and only the key
    ranges that differ are joined.
    """
    keys, measures = column_list(keys), column_list(measures)
    for df, what in ((left, "left table"), (right, "right table")):
        require_columns(df, [*keys, *measures], what)

    if mismatches_only:
        left, right = differing_ranges(left, right, keys, measures)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, *[measure(m).alias(f"__{name}_{m}") for m in measures], F.lit(True).alias(f"in_{name}"))

    both = null_safe_join(side(left, "left"), side(right, "right"), keys, "full")
    both = both.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("in_left", "in_right")})
    rows = both.select(
        *keys,
        "in_left",
        "in_right",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("measure"),
                        F.col(f"__left_{m}").alias("left_value"),
                        F.col(f"__right_{m}").alias("right_value"),
                    )
                    for m in measures
                ]
            )
        ),
    )
    a, b = F.col("left_value"), F.col("right_value")
    close = F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())
    out = rows.withColumn("agrees", F.col("in_left") & F.col("in_right") & close)
    return out.where(~F.col("agrees")) if mismatches_only else out


def row_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts of two tables and whether they are equal, in one row."""
    tagged = left.select(F.lit(1).alias("__l")).unionByName(right.select(F.lit(0).alias("__l")))
    counts = tagged.agg(
        F.count_if(F.col("__l") == 1).alias("n_left"), F.count_if(F.col("__l") == 0).alias("n_right")
    )
    return counts.withColumn("equal", F.col("n_left") == F.col("n_right"))


def total_of_components(columns: Sequence[str]):
    """Row-wise sum of component columns, missing ones counting as 0."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0.0)))
