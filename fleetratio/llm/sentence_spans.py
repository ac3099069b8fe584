"""Substring dedup by sliding sentence spans.

From every sentence of a document a span runs over the fewest consecutive sentences, at least two, that hold
at least fifteen words; with ``both_ends`` another such span ends at every sentence, and the two kinds together
cover every repeated run that meets both limits. Spans meet by hash over the whole corpus; sentences that a span covers go unless that
span is its first occurrence.

A span is known by a 64-bit hash: among n spans two different ones are taken for one with a chance of n^2 / 2^65.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetratio.llm.common import boxed, same_document, stored, text_of

#: A sentence ends after its mark and a space, or at a line break; the pieces add up to the text.
BREAK = r"(?<=[.!?]\x20)|(?<=\n)"
MIN_SENTENCES, MIN_WORDS = 2, 15
#: A span is hot if it has more than this share of all occurrences, so at most 1 / share are, and more than the floor.
HOT_SHARE, HOT_FLOOR = 1e-4, 100
#: Parts that the occurrences of a hot span are dealt to by their document.
HOT_PARTS = 64


def sentence_pieces(text: str) -> list[str]:
    return re.split(BREAK, text)


def document_spans(text: str, min_sentences: int, min_words: int, both_ends: bool = False) -> list[tuple[int, int, int]]:
    """(hash, first piece, last piece) of each span; pieces without a word are passed over."""
    worded = [(k, piece.encode().lower().split()) for k, piece in enumerate(sentence_pieces(text))]
    worded = [(k, words) for k, words in worded if words]
    hashes = [xxhash.xxh64_digest(b" ".join(words)) for _, words in worded]
    upto = np.concatenate(([0], np.cumsum([len(words) for _, words in worded], dtype=np.int64)))
    starts = np.arange(len(worded))
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + min_words), starts + min_sentences)
    runs = [(s, e) for s, e in zip(starts.tolist(), ends.tolist()) if e <= len(worded)]
    if both_ends:
        stops = starts + 1
        begins = np.minimum(np.searchsorted(upto, upto[1:] - min_words, side="right") - 1, stops - min_sentences)
        runs += [(s, e) for s, e in zip(begins.tolist(), stops.tolist()) if s >= 0 and ends[s] != e]
    out = []
    for s, e in runs:
        out.append((xxhash.xxh64_intdigest(b"".join(hashes[s:e])), worded[s][0], worded[e - 1][0]))
    return out


def corpus_spans(docs: DataFrame, min_sentences: int, min_words: int, both_ends: bool = False) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, hashes, texts = batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), batch["text"].to_pylist()
            for at in range(0, len(texts), 500):
                part = [document_spans(t, min_sentences, min_words, both_ends) for t in texts[at : at + 500]]
                counts = [len(p) for p in part]
                flat = [x for p in part for x in p]
                rows = np.repeat(np.arange(at, at + len(part)), counts)
                span = np.array([x[0] for x in flat], np.uint64).view(np.int64)
                first, last = (np.array([x[k] for x in flat], np.int32) for k in (1, 2))
                take = rows.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(span), pa.array([ids[r] for r in take], pa.int64()), pa.array([hashes[r] for r in take], pa.int64()), pa.array(first), pa.array(last)],
                    ["span", "doc_id", "text_hash", "first", "last"],
                )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash"))
    return keyed.mapInArrow(run, "span long, doc_id long, text_hash long, first int, last int")


def repeated_sentences(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, both_ends: bool = False) -> DataFrame:
    """(doc_id, text_hash, removed): numbers of the pieces that go, for each document that loses one.

    The first occurrence of a span is that with the least doc_id (null last), then text hash, then place. Null
    and empty texts and texts with fewer sentences or words have no span. Rows equal in doc_id and text are one
    document. An empty table gives an empty result; other columns are not read.
    """
    spans = stored(corpus_spans(docs, min_sentences, min_words, both_ends), "sentence-spans")
    where = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash", "first")
    # counted and summed before the shuffle; a span that half the corpus holds is one row
    found = spans.groupBy("span").agg(F.min(where).alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    limit = max(HOT_FLOOR, HOT_SHARE * spans.count())
    # the list of hot spans is short; their occurrences are dealt to parts, and their keepers repeated for each part
    hot = found.filter(F.col("n") > limit).select("span", F.col("keeper").alias("hot_keeper"))
    known = spans.join(F.broadcast(hot), "span", "left")
    dealt = F.when(F.col("hot_keeper").isNotNull(), F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(HOT_PARTS)).cast("int")).otherwise(F.lit(0))
    parts = F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    keepers = found.select("span", "keeper", F.explode(parts).alias("part"))
    later = known.withColumn("part", dealt).join(keepers, ["span", "part"]).filter(~where.eqNullSafe(F.col("keeper")))
    covered = later.select("doc_id", "text_hash", F.explode(F.sequence("first", "last")).alias("piece"))
    return covered.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("piece")).alias("removed"))


def drop_repeated_sentences(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, both_ends: bool = False) -> DataFrame:
    """``docs`` without the sentences of repeated spans; columns and rows stay, a null text stays null."""
    joined = boxed(docs).join(repeated_sentences(docs, min_sentences, min_words, both_ends), same_document(), "left")
    pieces = F.split("row.text", BREAK, -1)
    left = F.filter(F.transform(pieces, lambda x, i: F.when(~F.array_contains("removed", i), x)), lambda x: x.isNotNull())
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(left, ""))
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")
