"""Importance resampling towards a target distribution, over hashed n-grams.

Separators collapse to single spaces; an overlapped regex scan with boundary lookarounds then yields the span of
every n-gram, whose bytes go straight into a CRC. Bucket counts of the documents and of the target give each bucket
a gain; a document's weight is the sum of its gains, and Gumbel noise of its id turns weights into a weighted draw
without replacement: the highest scores.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetratio.llm.common import boxed, numbered, same_document, stored, text_of

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: What lies between words once A-Z are lower-cased: ASCII other than digits and letters.
SEPARATORS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS = 10_000


def gram_pattern(n: int) -> regex.Pattern:
    """Runs of ``n`` words between single spaces; to be searched overlapped."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def bucket_counts(text: bytes, patterns: list[regex.Pattern], buckets: int = BUCKETS) -> tuple[int, dict[int, int]]:
    """(number of words, features by bucket) of a text; the patterns are those of 1, 2, … words."""
    flat = SEPARATORS.sub(b" ", text.translate(LOWER)).strip(b" ")
    n_words, found = 0, Counter()
    for k, pattern in enumerate(patterns):
        grams = Counter(flat[slice(*m.span())] for m in pattern.finditer(flat, overlapped=True))
        if k == 0:
            n_words = grams.total()
        for gram, n in grams.items():
            found[crc32(gram) % buckets] += n
    return n_words, found


def bucket_features(docs: DataFrame, id_column: str = "doc_id", max_n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, bucket, n): the features of each text by bucket, as two arrays."""

    def run(batches):
        patterns = [gram_pattern(n) for n in range(1, max_n + 1)]
        for batch in batches:
            counted = [bucket_counts(t, patterns, buckets) for t in batch["text"].to_pylist()]
            sizes = np.cumsum([0, *(len(f) for _, f in counted)]).astype(np.int32)
            keys = np.fromiter((b for _, f in counted for b in f), np.int32, sizes[-1])
            values = np.fromiter((v for _, f in counted for v in f.values()), np.int64, sizes[-1])
            columns = {
                "doc_id": batch["doc_id"],
                "text_hash": batch["text_hash"],
                "n_words": pa.array([w for w, _ in counted], pa.int64()),
                "n_features": pa.array([f.total() for _, f in counted], pa.int64()),
                "bucket": pa.ListArray.from_arrays(pa.array(sizes), pa.array(keys)),
                "n": pa.ListArray.from_arrays(pa.array(sizes), pa.array(values)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    keyed = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of().cast("binary").alias("text"), F.xxhash64(text_of()).alias("text_hash"))
    return keyed.mapInArrow(run, "doc_id long, text_hash long, n_words long, n_features long, bucket array<int>, n array<long>")


def bucket_totals(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows; each task sums its own before anything is shuffled."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(sums, batch["bucket"].flatten().to_numpy(), batch["n"].flatten().to_numpy())
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], ["bucket", "n"])

    return features.select("bucket", "n").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(totals: DataFrame, buckets: int) -> np.ndarray:
    """At most ``buckets`` rows, whatever the size of the corpus."""
    out = np.zeros(buckets, np.float64)
    for row in totals.collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    buckets = len(corpus)
    ratio = (target + 1) * (corpus.sum() + buckets) / ((corpus + 1) * (target.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def importance_scores(docs: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = BUCKETS, seed: str = "2024") -> DataFrame:
    """One row for each document: doc_id, text_hash, n_words, n_features, weight, score.

    A null or empty text has no features and weight 0. A null id draws like an empty one. Repeated rows keep one
    row each with the same score; an empty corpus gives no row, an empty target equal target shares. Only ``doc_id``
    and ``text`` are read.
    """
    features = stored(bucket_features(docs, "doc_id", max_n, buckets), "bucket-features")
    wanted = bucket_features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "doc_id", max_n, buckets)
    gains = bucket_gains(_dense(bucket_totals(features, buckets), buckets), _dense(bucket_totals(wanted, buckets), buckets))

    def weigh(batches):
        for batch in batches:
            ends = np.concatenate(([0], np.cumsum(gains[batch["bucket"].flatten().to_numpy()] * batch["n"].flatten().to_numpy())))
            cuts = batch["bucket"].offsets.to_numpy()
            cuts = cuts - cuts[0]
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("doc_id", "text_hash", "n_words", "n_features")} | {"weight": pa.array(ends[cuts[1:]] - ends[cuts[:-1]])})

    weighed = features.mapInArrow(weigh, "doc_id long, text_hash long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(draw))).cast("long"))


def importance_draw(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, max_n: int = 1, buckets: int = BUCKETS, seed: str = "2024") -> DataFrame:
    """``importance_scores`` with ``rank``: 1, 2, … over the ``percent`` of the documents of ``min_words`` words
    or more that score highest, ties to the smaller doc_id (null last); null for all others.

    The rows are sorted by range and numbered in their ranges; only a count reaches the driver.
    """
    scored = stored(importance_scores(docs, target, max_n, buckets, seed), "importance-scores")
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash")]
    placed = numbered(able, order, "place").withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")).cast("long")).drop("place")
    return placed.unionByName(scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, **kw) -> DataFrame:
    """The rows of ``docs`` drawn by ``importance_draw``; rows equal in id and text to a drawn one come with it."""
    drawn = importance_draw(docs, target, percent, min_words, **kw).filter("rank IS NOT NULL").select("doc_id", "text_hash")
    return boxed(docs).join(drawn, same_document(), "left_semi").select("row.*")
