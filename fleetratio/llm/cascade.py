"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects a document by a condition on features of its text. Cost and selectivity of every rule are
measured on a sample; the rules then run in the order of rejections per second, and a document that one rule
rejects is not looked at by the next. The order changes the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetratio.llm.common import WORD, let, stored, text_of

WINDOW = 5


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long")


def count_symbols(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))


def count_lines(text: Column) -> Column:
    return F.size(worded_lines(text)).cast("long")


def count_dup_lines(text: Column) -> Column:
    return let(worded_lines(text), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))


def count_repeat_words(text: Column) -> Column:
    """Words inside a window of five words that the text has twice or more.

    A window is a 64-bit hash whose low bits give way to its place (as many bits as the text needs), so sorting
    one array of longs brings equal windows together. Two different windows of one text of n words meet in the
    remaining bits with a chance of n^3 / 2^65 or less: 1e-11 for a thousand words.
    """

    def covered(places: Column) -> Column:
        def step(i):
            following = F.when(i + 1 < F.size(places), places[i + 1]).otherwise(F.lit(2**62))
            return F.least(F.lit(WINDOW).cast("long"), following - places[i])

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.size(places) - 1), step), F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(tagged: Column, keep: Column) -> Column:
        def same(i, j):
            return tagged[i].bitwiseAND(keep) == tagged[j].bitwiseAND(keep)

        last = F.size(tagged) - 1
        at = F.filter(
            F.sequence(F.lit(0), last), lambda i: F.when((i > 0) & same(F.greatest(i - 1, F.lit(0)), i), True).otherwise((i < last) & same(F.least(i + 1, last), i))
        )
        places = F.sort_array(F.transform(at, lambda i: tagged[i].bitwiseAND(F.bitwise_not(keep))))
        return let(places, lambda ps: F.when(F.size(ps) > 0, covered(ps)).otherwise(F.lit(0).cast("long")))

    def of(hashes: Column) -> Column:
        n = F.size(hashes)
        keep = F.call_function("shiftleft", F.lit(-1).cast("long"), F.char_length(F.bin(n)))
        windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)]).bitwiseAND(keep).bitwiseOR(i.cast("long")))
        return F.when(n > WINDOW, let(F.sort_array(windows), lambda t: let(keep, lambda k: repeated(t, k)))).otherwise(F.lit(0).cast("long"))

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), of)


@dataclass(frozen=True)
class Rule:
    """Rejects where ``reject(features)`` holds; ``features`` gives a feature's column by name."""

    name: str
    reject: Callable[[Callable[[str], Column]], Column]


FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": count_words,
    "word_chars": word_chars,
    "n_symbols": count_symbols,
    "n_lines": count_lines,
    "n_dup_lines": count_dup_lines,
    "n_repeat_words": count_repeat_words,
}

RULES = (
    Rule("few_words", lambda f: f("n_words") < 10),
    Rule("repeats", lambda f: 100 * f("n_repeat_words") > 20 * f("n_words")),
    Rule("word_length", lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 15 * f("n_words"))),
    Rule("symbols", lambda f: 4 * f("n_symbols") > f("n_words")),
    Rule("dup_lines", lambda f: 2 * f("n_dup_lines") > f("n_lines")),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: int

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def measure_rules(docs: DataFrame, rules=RULES, sample_rows: int = 2_000, seed: int = 7) -> list[Measured]:
    """Time and rejections of each rule over a sample of about ``sample_rows`` rows, best gain first."""
    rows = docs.count()
    if not rows:
        return [Measured(r, 0.0, 0) for r in rules]
    sample = stored(docs.select(text_of().alias("text")).sample(fraction=min(1.0, sample_rows / rows), seed=seed), "rule-sample")
    out = []
    for rule in [None, *rules]:
        begun = time.perf_counter()
        condition = rule.reject(lambda name: FEATURES[name](F.col("text"))) if rule else F.col("text").isNull()
        rejected = sample.agg(F.count(F.when(condition, 1)).alias("n")).first()["n"]
        out.append(Measured(rule, time.perf_counter() - begun, rejected))
    empty = out[0].seconds  # a scan without a rule
    return sorted((Measured(m.rule, max(m.seconds - empty, 1e-3), m.rejected) for m in out[1:]), key=lambda m: -m.gain)


def rejected_by(ordered: list[Rule], features: Callable[[str], Column]) -> Column:
    """Name of the first rule that rejects, else null; later rules are not evaluated."""
    out = None
    for rule in ordered:
        out = F.when(rule.reject(features), rule.name) if out is None else out.when(rule.reject(features), rule.name)
    return out


def cascade_filter(docs: DataFrame, rules=RULES, sample_rows: int = 2_000) -> DataFrame:
    """The documents no rule rejects, features computed only as far as the cascade runs.

    A null text counts as empty and is rejected for its few words. Further columns pass through.
    """
    ordered = [m.rule for m in measure_rules(docs, rules, sample_rows)]
    return docs.filter(rejected_by(ordered, lambda name: FEATURES[name](text_of())).isNull())


def cascade_report(docs: DataFrame, rules=RULES, sample_rows: int = 2_000) -> DataFrame:
    """One row for each document: doc_id, every feature, ``rejected_by`` and ``kept``.

    Here all features are wanted, so they are computed once and the cascade reads them. Null text: empty.
    Repeated rows and null ids give one row each; an empty table an empty result.
    """
    ordered = [m.rule for m in measure_rules(docs, rules, sample_rows)]
    featured = docs.select("doc_id", *[make(text_of()).alias(name) for name, make in FEATURES.items()])
    judged = featured.withColumn("rejected_by", rejected_by(ordered, F.col))
    return judged.withColumn("kept", F.col("rejected_by").isNull())
