"""The registered queries of this subpackage, one thin query for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetratio.llm.cascade import cascade_report
from fleetratio.llm.common import table
from fleetratio.llm.contextual_pii import KINDS, find_personal_data
from fleetratio.llm.curriculum import curriculum
from fleetratio.llm.fuzzy_lines import line_report
from fleetratio.llm.importance_resampling import importance_draw
from fleetratio.llm.oneperm_minhash import near_duplicate_sets
from fleetratio.llm.qgram_decontamination import contaminated
from fleetratio.llm.sentence_spans import repeated_sentences
from fleetratio.llm.simhash_pivots import near_duplicates
from fleetratio.llm.suffix_two_stage import remove_repeated_strings
from fleetratio.llm.tokenizer_alignment import alignment_statistics, read_vocabularies
from fleetratio.llm.trigram_secrets import BASE_RULES, find_secrets
from fleetratio.llm.warc_derivatives import derive_records

#: Where the public vocabularies lie.
A_VOCABULARY, B_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def _listed(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _span_digest(found: DataFrame, kinds) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_records(table(spark, sf_dir, "pages"))


def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")), KINDS[:4])


def op3_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    first = F.round(F.array_min(F.transform("visits", lambda v: v["position"])), 9)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position")).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = repeated_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"), both_ends=True)
    return gone.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"))


def op6_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = cascade_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return report.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept")
    )


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")), [r.name for r in BASE_RULES])


def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, limit=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_suffix_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_strings(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_overlapped_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_draw(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_diagonal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"), read_vocabularies(A_VOCABULARY, B_VOCABULARY))


def op13_oneperm_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_sets(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_contextual_pii": op2_contextual_pii,
    "op3_qgram_decontamination": op3_qgram_decontamination,
    "op4_curriculum_mix": op4_curriculum_mix,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_rule_cascade": op6_rule_cascade,
    "op7_fuzzy_lines": op7_fuzzy_lines,
    "op8_trigram_secrets": op8_trigram_secrets,
    "op9_simhash_pivots": op9_simhash_pivots,
    "op10_suffix_two_stage": op10_suffix_two_stage,
    "op11_overlapped_resampling": op11_overlapped_resampling,
    "op12_diagonal_alignment": op12_diagonal_alignment,
    "op13_oneperm_minhash": op13_oneperm_minhash,
}
