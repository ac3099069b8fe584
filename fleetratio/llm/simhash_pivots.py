"""SimHash near-duplicates with pivot distance tables.

Documents become 64-bit fingerprints. The Hamming distances of every fingerprint to a set of reference fingerprints
are tabled once; by the triangle inequality two fingerprints further apart in any coordinate than the limit
cannot be within it, and only pairs that pass in every coordinate are compared bit by bit.

The tables discard pairs but do not find them: one coordinate lets more than half of all pairs pass, so a grid
over coordinates would repeat each fingerprint more often than it saves. Pairs are therefore formed among
fingerprints that agree in two of ``limit + 2`` bit blocks, which every pair within the limit does.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetratio.llm.common import Forest, boxed, same_document, stored, text_of, whole_groups
from fleetratio.llm.components import connected_components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
PIVOTS = 16
#: Fingerprints of one bucket compared in one go; a larger bucket is cut into tiles and tiles meet pairwise.
TILE = 4096


def fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit majority vote over the XXH64 hashes of the word shingles; 0 without words."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    span = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - span + 1].tolist()
    hashing, votes, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):  # long texts in pieces
        pairs = zip(starts[at : at + (1 << 16)], ends[span - 1 + at : span - 1 + at + (1 << 16)].tolist())
        hashes = np.array([hashing(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp); a null text counts as empty."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch["text"].to_pylist()), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(fps)], ["doc_id", "text_hash", "fp"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash"))
    return keyed.mapInArrow(run, "doc_id long, text_hash long, fp long")


def with_pivot_distances(fps: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Adds ``distances``, one byte for each pivot; pivots are hashes of their numbers."""
    refs = [xxhash.xxh64_intdigest(str(k), SEED) for k in range(pivots)]

    def run(batches):
        points = np.array(refs, np.uint64)
        for batch in batches:
            fp = batch["fp"].to_numpy().view(np.uint64)
            table = np.bitwise_count(fp[:, None] ^ points[None, :]).astype(np.uint8)
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(pivots), len(fp), [None, pa.py_buffer(table.tobytes())])
            yield pa.RecordBatch.from_arrays([batch["fp"], rows.cast(pa.binary())], ["fp", "distances"])

    return fps.select("fp").mapInArrow(run, "fp long, distances binary")


def _bucketed(table: DataFrame, limit: int) -> DataFrame:
    """Each fingerprint once for every pair of bit blocks, with the bits of the pair as bucket."""
    blocks = limit + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    each = [
        F.struct(F.lit(n).alias("block"), F.col("fp").bitwiseAND(F.lit(signed(masks[a] | masks[b]))).alias("bits"))
        for n, (a, b) in enumerate(combinations(range(blocks), 2))
    ]
    return table.select("fp", "distances", F.explode(F.array(*each)).alias("k")).select("k.block", "k.bits", "fp", "distances")


def _links(batches, limit: int):
    """A spanning forest of the links in each group of sorted rows (block, bits, low, high, fp, distances)."""
    for table in whole_groups(batches, ["block", "bits", "low", "high"]):
        fp = table["fp"].to_numpy().view(np.uint64)
        n = len(fp)
        near = np.frombuffer(b"".join(table["distances"].to_pylist()), np.uint8).reshape(n, -1).astype(np.int16)
        group = np.zeros(n, np.int64)
        for key in ("block", "bits", "low", "high"):
            values = table[key].to_numpy()
            group[1:] |= values[1:] != values[:-1]
        group = np.cumsum(group)
        forest, out = Forest(n), []
        alive, lag = np.arange(n - 1), 1
        while len(alive):
            alive = alive[alive + lag < n]
            other = alive + lag
            # rows are sorted by their first coordinate: once it is too far, it stays so
            going = (group[alive] == group[other]) & (near[other, 0] - near[alive, 0] <= limit)
            alive, other = alive[going], other[going]
            apart = forest.label[alive] != forest.label[other]
            a, b = alive[apart], other[apart]
            a, b = (x[np.abs(near[a] - near[b]).max(axis=1) <= limit] for x in (a, b)) if len(a) else (a, b)
            linked = np.bitwise_count(fp[a] ^ fp[b]) <= limit
            a, b = a[linked], b[linked]
            if len(a):
                used = forest.join(a, b)
                out.append((fp[a[used]], fp[b[used]]))
            lag += 1
        if out:
            left, right = (np.concatenate(x).view(np.int64) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])


def fingerprint_links(fps: DataFrame, limit: int = 4, pivots: int = PIVOTS) -> DataFrame:
    """Links (a, b) between distinct fingerprints at ``limit`` or fewer differing bits, enough to connect all that are."""
    table = stored(with_pivot_distances(fps, pivots), "pivot-distances")
    rows = _bucketed(table, limit)
    shared = rows.groupBy("block", "bits").count().filter("count > 1")
    sized = rows.join(shared, ["block", "bits"])
    tiles = F.ceil(F.col("count") / TILE).cast("int")
    own = F.pmod(F.hash("fp"), tiles)
    met = F.explode(F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.least(own, t).alias("low"), F.greatest(own, t).alias("high"))))
    units = sized.withColumn("tile", met).select("block", "bits", "tile.low", "tile.high", "fp", "distances")
    placed = units.repartition("block", "bits", "low", "high").sortWithinPartitions("block", "bits", "low", "high", "distances")
    return placed.mapInArrow(lambda batches: _links(batches, limit), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, limit: int = 4, pivots: int = PIVOTS) -> DataFrame:
    """One row for each document: doc_id, text_hash, fp, group, component_id.

    Documents whose fingerprints differ in ``limit`` bits or fewer are linked, and so are chains of them. ``group``
    is the least fingerprint of the component, ``component_id`` its least doc_id that is not null. Exact copies
    share a fingerprint and meet before any pair is formed. Null and empty texts have fingerprint 0. Repeated
    rows and null ids keep one row each; an empty table gives an empty result; other columns are not read.
    """
    members = stored(with_fingerprints(docs, shingle), "fingerprints")
    fps = stored(members.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(fps, limit, pivots))
    grouped = stored(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("group")), "groups")
    firsts = grouped.groupBy("group").agg(F.min("first_id").alias("component_id"))
    labels = grouped.join(firsts, "group").select("fp", "group", "component_id")
    return members.join(labels, "fp").select("doc_id", "text_hash", "fp", "group", "component_id")


def keep_one_each(docs: DataFrame, shingle: int = 4, limit: int = 4) -> DataFrame:
    """``docs`` with one document of each group: the one with the least doc_id (null last), then text hash.

    Of equal rows one stays.
    """
    found = near_duplicates(docs, shingle, limit)
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    kept = found.groupBy("group").agg(F.min(rank).alias("r")).select("r.doc_id", "r.text_hash")
    stays = boxed(docs).join(kept, same_document(), "left_semi")
    return stays.dropDuplicates(["key_id", "key_hash"]).select("row.*")
