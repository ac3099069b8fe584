"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight, which sets how many words the mix takes from it, and a schedule of weights over
training time, which sets when. The schedule is integrated to a cumulative demand; a document's place in its
source's queue is a cumulative supply; inverting the demand at that supply gives the document's training
position, and the mix is range-sorted by position.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetratio.llm.common import WORD, numbered, stored, text_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Knots (time, weight) of piecewise linear schedules, repeating like the weights: fading out, level, coming in late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
#: First hex digits of a document's key that name its bucket: 4096 buckets a source, whatever its size.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def invert_schedule(share: Column, knots) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches ``share`` of its total."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, before, out = sum(areas), 0.0, None
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
        rest = share * F.lit(total) - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / (t1 - t0)) * rest, F.lit(0.0)))
        time = F.lit(t0) + F.coalesce(F.try_divide(F.lit(2.0) * rest, F.lit(w0) + root), F.lit(0.0))
        before += area
        out = F.when(share * F.lit(total) <= F.lit(before), time) if out is None else out.when(share * F.lit(total) <= F.lit(before), time)
    return out.otherwise(F.lit(knots[-1][0]))


def source_targets(totals: DataFrame, weights=WEIGHTS, share=Fraction(3, 2), passes: int = 2) -> DataFrame:
    """Adds ``kind`` (which weight and schedule), ``target`` to rows (source_key, source, source_size).

    ``share`` of all words is divided by weight; a source stops at ``passes`` times its size and what it cannot
    give is shared again by weight until none is above. Each round is one sum over the sources, in whole numbers.
    """
    ranked = numbered(totals, [F.col("source").asc_nulls_last()], "rank").withColumn("kind", ((F.col("rank") - 1) % len(weights)).cast("int"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("kind") + 1).cast("decimal(38,0)")
    limit = (F.col("source_size") * passes).cast("decimal(38,0)")
    num, den = share.numerator, share.denominator

    def sums(full: Column):
        row = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(~full, weight)), F.lit(0)).alias("open"),
        ).first()
        return int(row["all"]), int(row["given"]), int(row["open"])

    full = F.lit(False)
    everything, given, still = sums(full)
    while still:
        left = num * everything - den * given
        full = F.lit(Decimal(left)) * weight > F.lit(Decimal(den * still)) * limit
        state = sums(full)[1:]
        if state == (given, still):
            break
        given, still = state
    left = num * everything - den * given
    open_target = (F.lit(left) * weight.cast("long")).cast("double") / F.lit(float(den * max(still, 1)))
    return ranked.withColumn("target", F.when(full, limit.cast("double")).otherwise(open_target)).drop("rank")


def curriculum(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share=Fraction(3, 2), passes: int = 2, seed: str = "mix") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` and ``visits``.

    ``visits`` lists (pass, taken, position) of each time the mix takes the document; position runs from 0 to 1.
    Within a source documents queue by a hash of their id; the queue is read up to ``passes`` times until the
    target is met, and the last document taken is cut at the target, so a source gives exactly ``floor(target)``
    words. A queue is added up in buckets of the hash, so a large source is spread over many tasks.

    Null and empty texts have size 0 and are not taken. Rows with a null id queue together. Rows with the same id
    queue next to each other by size; equal rows can be taken differently, but as a set they come out the same.
    A null source is a source, the last. An empty table gives an empty result. Further columns pass through;
    those with the names used here are replaced.
    """
    new = ["size", "source_size", "target", "kind", "taken", "visits", "source_key", "queue_key", "bucket", "words", "_offset", "_upto"]
    sized = (
        docs.drop(*new)
        .withColumn("size", word_count(text_of()))
        .withColumn("source_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
        .withColumn("queue_key", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        .withColumn("bucket", F.substring("queue_key", 1, BUCKET_DIGITS))
    )
    sums = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"), F.max("source").alias("source"))
    buckets = stored(sums, "bucket-words")
    before = Window.partitionBy("source_key").orderBy("bucket")
    totals = buckets.groupBy("source_key").agg(F.sum("words").alias("source_size"), F.max("source").alias("source"))
    targets = source_targets(totals, weights, share, passes).drop("source")
    offsets = buckets.select(
        "source_key", "bucket", (F.sum("words").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("_offset")
    ).join(targets, "source_key")
    own = Window.partitionBy("source_key", "bucket").orderBy("queue_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("_upto", F.sum("size").over(own)).join(offsets, ["source_key", "bucket"])
    start = F.col("_offset") + F.col("_upto") - F.col("size")
    wanted = F.floor("target")

    def visit(p: int) -> Column:
        at = start + F.col("source_size") * p
        took = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), wanted - at))
        part = F.try_divide(at.cast("double") + took.cast("double") / F.lit(2.0), wanted.cast("double"))
        position = F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            position = F.when(F.col("kind") % len(schedules) == k, invert_schedule(part, knots)).otherwise(position)
        return F.struct(F.lit(p).alias("pass"), took.alias("taken"), position.alias("position"))

    visits = F.filter(F.array(*[visit(p) for p in range(passes)]), lambda v: v["taken"] > 0)
    return (
        placed.withColumn("visits", visits)
        .withColumn("taken", F.aggregate("visits", F.lit(0).cast("long"), lambda a, v: a + v["taken"]))
        .drop("source_key", "queue_key", "bucket", "kind", "_offset", "_upto")
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row for each visit with pass, taken and position, range-sorted by training position."""
    each = mixed.drop("visit", "pass", "position").withColumn("visit", F.explode("visits")).drop("visits", "taken")
    return each.select("*", F.col("visit.pass").alias("pass"), F.col("visit.taken").alias("taken"), F.col("visit.position").alias("position")).drop("visit").orderBy("position", "doc_id", "pass")
