"""Secret scan over a trigram inverted index, in DataFrame functions only.

A regex that matches must contain one of some sets of trigrams. These sets are derived from each rule, the index
holds the postings of just those trigrams, intersecting the postings gives each rule's candidate documents, and
the regex itself runs on these alone. A rule without mandatory trigrams runs on every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetratio.llm.common import let, match_spans, stored, text_of

#: Alternatives kept while a rule's strings are spelled out; beyond it the run of literals is cut, which only widens the candidates.
MAX_STRINGS = 64


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` with at least ``least`` characters in ``group`` (0: the whole match)."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    SecretRule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 18),
    SecretRule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[0-9A-Za-z_-]{35}"),
    SecretRule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\."),
)
RULES = BASE_RULES + MORE_RULES


def _spell(item) -> list[str] | None:
    """All lower-cased strings of one parsed item, or None if they are too many."""
    op, arg = item
    if op is sre.LITERAL:
        return [chr(arg).lower()]
    if op is sre.IN and all(kind is sre.LITERAL for kind, _ in arg):
        return sorted({chr(code).lower() for _, code in arg})
    if op is sre.SUBPATTERN:
        return _spell_all(arg[3])
    if op is sre.BRANCH:
        parts = [_spell_all(x) for x in arg[1]]
        return None if None in parts else [s for p in parts for s in p]
    if op is sre.MAX_REPEAT and arg[1] == 1:
        inner = _spell_all(arg[2])
        return None if inner is None else ([] if arg[0] else [""]) + inner
    if op is sre.MAX_REPEAT and arg[0] == arg[1] and arg[0] <= 8:
        return _spell_all(list(arg[2]) * arg[0])
    return None


def _spell_all(items) -> list[str] | None:
    out = [""]
    for item in items:
        strings = _spell(item)
        if strings is None or len(out) * len(strings) > MAX_STRINGS:
            return None
        out = [a + b for a, b in product(out, strings)]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of trigrams, of which a matching text holds at least one whole; None if none are mandatory.

    Runs of spelled-out strings become alternatives of trigram sets. The run with the longest shortest
    alternative is taken; a text with a match contains one of its strings.
    """
    runs, current = [], [""]
    for item in [*_parser.parse(pattern), None]:
        strings = _spell(item) if item else None
        if strings is not None and len(current) * len(strings) <= MAX_STRINGS:
            current = [a + b for a, b in product(current, strings)]
            continue
        runs.append(current)
        current = strings if strings is not None else [""]
    best = max(runs, key=lambda strings: min(map(len, strings)))
    if min(map(len, best)) < 3:
        return None
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in best}
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def _spans(text: Column, rule: SecretRule, number: int) -> Column:
    found = match_spans(text, rule.pattern, rule.group or None)
    if rule.least:
        found = F.filter(found, lambda m: F.char_length(m["part"] if rule.group else m["match"]) >= rule.least)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("order"), m["end"].alias("end"), F.lit(rule.name).alias("kind")))


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row for each document: doc_id and ``spans``, an array of (start, order, end, kind) by start, then rule.

    Positions are code points, end exclusive. Null text: no spans. Repeated rows, ties and null ids keep one row
    each; texts of rows with one id are told apart by their hash. An empty table gives an empty result, other
    columns of ``docs`` are not read.
    """
    queries = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    scanned = [k for k, q in queries.items() if q is None]
    clauses = [(k, clause) for k, q in queries.items() if q for clause in q]
    wanted: dict[str, list[tuple[int, int, int]]] = {}
    for c, (_, clause) in enumerate(clauses):
        for bit, term in enumerate(sorted(clause)):
            wanted.setdefault(term, []).append((c, bit))
    vocabulary = F.array(*[F.lit(t) for t in sorted(wanted)]) if wanted else F.array().cast("array<string>")
    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))

    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    everywhere = F.flatten(F.array(none, *[_spans(F.col("text"), rules[k], k) for k in scanned]))
    held = let(F.lower("text"), lambda low: F.filter(vocabulary, lambda t: F.contains(low, t)))
    indexed = stored(keyed.select("doc_id", "text_hash", everywhere.alias("scan_spans"), held.alias("terms")), "trigram-index")
    if not wanted:
        return indexed.select("doc_id", F.array_sort("scan_spans").alias("spans"))

    places = F.create_map(*[x for t in sorted(wanted) for x in (F.lit(t), F.array(*[F.struct(F.lit(c).alias("clause"), F.lit(1 << b).cast("long").alias("bit")) for c, b in wanted[t]]))])
    postings = indexed.select(F.explode("terms").alias("term"), "doc_id", "text_hash")
    hits = postings.select("doc_id", "text_hash", F.explode(places[F.col("term")]).alias("hit")).select("doc_id", "text_hash", "hit.*")
    full = F.element_at(F.array(*[F.lit((1 << len(c)) - 1).cast("long") for _, c in clauses]), F.col("clause") + 1)
    rule_of = F.element_at(F.array(*[F.lit(k) for k, _ in clauses]), F.col("clause") + 1)
    met = hits.groupBy("doc_id", "text_hash", "clause").agg(F.bit_or("bit").alias("bits")).filter(F.col("bits") == full)
    candidates = stored(met.groupBy("doc_id", "text_hash").agg(F.collect_set(rule_of).alias("rules")), "trigram-candidates")

    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_hash") == F.col("c.text_hash"))
    to_verify = keyed.alias("d").join(candidates.alias("c"), same).select("d.doc_id", "d.text_hash", "text", "rules")
    verified = F.flatten(F.array(none, *[F.when(F.array_contains("rules", k), _spans(F.col("text"), rules[k], k)).otherwise(none) for k, q in queries.items() if q]))
    found = to_verify.select("doc_id", "text_hash", verified.alias("spans")).groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))
    both = F.array_sort(F.concat("scan_spans", F.coalesce("spans", none)))
    return indexed.alias("d").join(found.alias("c"), same, "left").select("d.doc_id", both.alias("spans"))
