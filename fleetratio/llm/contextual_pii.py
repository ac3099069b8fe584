"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Entities of known form (e-mail, address, card, telephone) are the seeds. The word before a seed and the word behind
it are lexical patterns; the identifier-like tokens beside the same word are further instances. Over the graph of
patterns and instances of the whole corpus scores pass back and forth: a pattern is as good as the instances it
extracts, an instance as good as its best pattern. An instance of high confidence supports patterns like a seed, so
identifiers found behind one word lead to the next word. Tokens beside patterns of high confidence are reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetratio.llm.common import let, match_spans, stored, text_of

KINDS = ("email", "ip", "card", "phone", "context")
#: Possessive forms of the contract's patterns: the same matches, without backtracking or recursion on long runs.
#: ``\G`` lets a match start where the last one ended, in the middle of a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A whole word with a digit or an at sign in it.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Part of 0 to 255, leading zeros allowed.
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Tokens whose seeds are looked up together; a seed has at most 19 digits, so it meets no more tokens than that.
TOKEN_BLOCK, SEED_TOKENS = 256, 20
#: Confidence is counted in millionths, so that sums do not depend on their order.
ONE = 1_000_000
SALTS = 16


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(turned, i):
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    def total(turned):
        return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), lambda a, i: a + value(turned, i))

    return let(F.reverse(digits), total) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Seeds: (order, start, end, kind, value) by kind, then start."""

    def shaped(order: int, spans: Column) -> Column:
        return F.transform(spans, lambda m: F.struct(F.lit(order).alias("order"), m["start"].alias("start"), m["end"].alias("end"), F.lit(KINDS[order]).alias("kind"), m["match"].alias("value")))

    none = F.array().cast("array<struct<order:int,start:int,end:int,kind:string,value:string>>")
    email = F.when(F.contains(text, F.lit("@")), shaped(0, match_spans(text, EMAIL))).otherwise(none)
    ip = shaped(1, F.filter(match_spans(text, IP), lambda m: m["match"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")))
    card_like = F.filter(match_spans(text, CARD), lambda m: F.char_length(_digits(m["match"])).between(13, 19))
    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), shaped(2, F.filter(card_like, lambda m: luhn(_digits(m["match"]))))).otherwise(none)
    phones = F.filter(match_spans(text, PHONE), lambda m: F.char_length(_digits(m["match"])).between(9, 15))
    phone = F.when(F.contains(text, F.lit("+")), shaped(3, phones)).otherwise(none)
    return F.when(text.rlike("[0-9@]"), F.concat(email, ip, card, phone)).otherwise(none)


def _tokens(text: Column) -> Column:
    """Words with a digit or an at sign as (start, end, match, left, right): with the words beside them, in small letters.

    The neighbours come from the pieces between the tokens, so the cost grows with the text, whatever its length.
    """

    def beside(ts, gaps):
        def context(m, i):
            before, behind = F.rtrim(gaps[i]), F.ltrim(gaps[i + 1])
            left = F.when(before != "", F.substring_index(before, " ", -1)).otherwise(F.coalesce(F.get(ts, i - 1)["match"], F.lit("")))
            right = F.when(behind != "", F.substring_index(behind, " ", 1)).otherwise(F.coalesce(F.get(ts, i + 1)["match"], F.lit("")))
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), F.lower(left).alias("left"), F.lower(right).alias("right"))

        return F.transform(ts, context)

    pieces = F.transform(F.split(text, TOKEN, -1), lambda g: F.translate(g, "\t\n\x0b\x0c\r", "     "))
    return let(match_spans(text, TOKEN), lambda ts: let(pieces, lambda gaps: beside(ts, gaps)))


def _instances(text: Column, base: Column, min_digits: int) -> Column:
    """(start, end, value, patterns, is_seed): whole base spans, and identifier-like tokens that touch none.

    The patterns of an instance are the word before the token it starts in and the word behind the token it ends in. A
    span that starts inside another, or behind another in one token, is no instance.
    """

    def item(start, end, value, left, right, is_seed: bool):
        sides = F.array(F.when(left != "", F.concat(F.lit("behind "), left)), F.when(right != "", F.concat(F.lit("before "), right)))
        return F.struct(start.alias("start"), end.alias("end"), value.alias("value"), F.filter(sides, lambda x: x.isNotNull()).alias("patterns"), F.lit(is_seed).alias("is_seed"))

    def block(ts, number):
        """The instances that start in one block of tokens; only the base spans that meet the block are looked at."""

        def seed(near, m, i):
            inside = F.filter(near, lambda b: (b["start"] >= m["start"]) & (b["start"] < m["end"]))
            lead = F.array_min(F.transform(inside, lambda b: F.struct(b["start"].alias("start"), (-b["end"]).alias("back"), b["value"].alias("value"))))
            free = lambda x: ~F.exists(near, lambda b: (b["start"] < x["start"]) & (b["end"] > x["start"]))
            touched = lambda x: F.filter(F.slice(ts, number * TOKEN_BLOCK + i + 1, SEED_TOKENS), lambda t: t["start"] < -x["back"])
            whole = lambda x: item(x["start"], -x["back"], x["value"], m["left"], F.element_at(touched(x), -1)["right"], True)
            return let(lead, lambda x: F.when(x.isNotNull() & free(x), whole(x)))

        def unseen(near, m):
            wanted = F.contains(m["match"], F.lit("@")) | (F.char_length(_digits(m["match"])) >= min_digits)
            return wanted & ~F.exists(near, lambda b: (m["start"] < b["end"]) & (m["end"] > b["start"]))

        def both(part, near):
            seeds = F.filter(F.transform(part, lambda m, i: seed(near, m, i)), lambda x: x.isNotNull())
            others = F.filter(part, lambda m: unseen(near, m))
            return F.concat(seeds, F.transform(others, lambda m: item(m["start"], m["end"], m["match"], m["left"], m["right"], False)))

        def near_by(part):
            return F.filter(base, lambda b: (b["end"] > part[0]["start"]) & (b["start"] < F.element_at(part, -1)["end"]))

        return let(F.slice(ts, number * TOKEN_BLOCK + 1, TOKEN_BLOCK), lambda part: let(near_by(part), lambda near: both(part, near)))

    def all_blocks(ts):
        numbers = F.sequence(F.lit(0), F.floor((F.size(ts) - 1) / TOKEN_BLOCK).cast("int"))
        return F.flatten(F.transform(numbers, lambda n: block(ts, n)))

    return F.when(text.rlike("[0-9@]"), let(_tokens(text), lambda ts: F.when(F.size(ts) > 0, all_blocks(ts))))


def _scored(edges: DataFrame, rounds: int, min_support: int, smoothing: int, threshold: int) -> DataFrame:
    """Accepted patterns of the graph ``edges`` (pattern, value, is_seed), rows distinct.

    A pattern counts once ``min_support`` different instances with a score of ``threshold`` or more stand beside it: in
    the first round the seeds, later also what accepted patterns have found.

    Joins on a pattern or a value are salted: one of them may have a third of all edges, and the scores,
    one row each, are repeated for every salt.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    edges = edges.withColumn("salt", F.pmod(F.hash("pattern", "value"), F.lit(SALTS)))
    seeds = edges.select("value", "is_seed").groupBy("value").agg(F.max("is_seed").alias("seed")).filter("seed").select("value", F.lit(ONE).cast("long").alias("score"))
    instances, patterns = seeds, None
    for _ in range(rounds):
        known = instances.withColumn("salt", salts)
        extracted = edges.join(known, ["value", "salt"], "left").withColumn("score", F.coalesce("score", F.lit(0).cast("long")))
        patterns = stored(
            extracted.groupBy("pattern")
            .agg(F.sum("score").alias("good"), F.count("*").alias("all"), F.count_if(F.col("score") >= threshold).alias("support"))
            .filter(F.col("support") >= min_support)
            .select("pattern", F.floor(F.col("good") / (F.col("all") + smoothing)).cast("long").alias("score")),
            "pii-patterns",
        )
        by_pattern = edges.join(patterns.withColumn("salt", salts), ["pattern", "salt"])
        instances = stored(
            by_pattern.select("value", F.when(F.col("is_seed"), F.lit(ONE).cast("long")).otherwise(F.col("score")).alias("score"))
            .unionByName(seeds)
            .groupBy("value")
            .agg(F.max("score").alias("score")),
            "pii-instances",
        )
    return patterns.filter(F.col("score") >= threshold).select("pattern")


def find_personal_data(docs: DataFrame, rounds: int = 6, min_support: int = 3, smoothing: int = 1, confidence: float = 0.7, min_digits: int = 6) -> DataFrame:
    """One row for each document: doc_id and ``spans``, an array of (order, start, end, kind) by kind, then start.

    Tokens of kind ``context`` hold an at sign or ``min_digits`` digits, touch no seed, and stand beside a pattern with
    ``min_support`` different accepted instances and a score of ``confidence`` or more after ``rounds`` rounds. Null text: no
    spans. Repeated rows and null ids keep one row each; an empty table gives an empty result; other columns are
    not read.
    """
    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    seeded = keyed.withColumn("base", base_spans(F.col("text")))

    plain = F.transform("base", lambda b: F.struct(*[b[c].alias(c) for c in ("order", "start", "end", "kind")])).alias("plain")
    found = stored(seeded.select("doc_id", "text_hash", plain, _instances(F.col("text"), F.col("base"), min_digits).alias("tokens")).withColumnRenamed("plain", "base"), "pii-tokens")

    occurrences = found.select("doc_id", "text_hash", F.explode("tokens").alias("t")).select("doc_id", "text_hash", "t.start", "t.end", "t.value", "t.is_seed", F.explode("t.patterns").alias("pattern"))
    edges = stored(occurrences.groupBy("pattern", "value").agg(F.max("is_seed").alias("is_seed")), "pii-edges")
    accepted = _scored(edges, rounds, min_support, smoothing, round(confidence * ONE))

    unseen = occurrences.filter("NOT is_seed").withColumn("salt", F.pmod(F.hash("doc_id", "start"), F.lit(SALTS)))
    discovered = unseen.join(accepted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["pattern", "salt"])
    item = F.struct(F.lit(4).alias("order"), F.col("start"), F.col("end"), F.lit(KINDS[4]).alias("kind"))
    more = discovered.groupBy("doc_id", "text_hash").agg(F.collect_set(item).alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<order:int,start:int,end:int,kind:string>>"))))
    key = F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("f.text_hash") == F.col("m.text_hash"))
    return found.alias("f").join(more.alias("m"), key, "left").select("f.doc_id", spans.alias("spans"))
