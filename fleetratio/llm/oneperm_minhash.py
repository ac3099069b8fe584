"""MinHash near-duplicates by one-permutation hashing.

One hash of each shingle serves the whole signature: its range is cut into bins and each bin keeps its least hash;
an empty bin borrows from a bin drawn by its own sequence of hashes (optimal densification). Bands of bins are
buckets. A bucket proposes a star, each member with the least one, so candidates grow with the documents, not with
the square of a bucket. Links are confirmed on full sets.

A star can miss a link between two members that are both unlike its centre. Buckets whose members still lie in
different components are therefore compared once more inside tasks: a parity sketch bounds the symmetric
difference of two sets from below, exactly, and pairs that pass it are confirmed until none is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetratio.llm.common import boxed, same_document, stored, text_of, whole_groups
from fleetratio.llm.components import connected_components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
#: Signatures: two sets at similarity s share none of 32 bands of 6 with a chance of (1 - s^6)^32, 6e-5 at 0.8.
BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
#: Draws of a donor for an empty bin; a bin that found none takes the next filled one.
PROBES = 4096
#: 64-bit words of the parity sketch.
SKETCH_WORDS = 16
#: Members of a mixed bucket compared in one go; tiles of a larger bucket meet pairwise.
TILE = 2048
#: Members of a star confirmed by one task.
STAR = 4096
#: Multipliers of a well-known 64-bit mixer.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words; remembers about a million."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < 1 << 20:
            self[word] = h
        return h


def shingle_set(text: bytes, shingle: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence where it is shorter."""
    words = text.translate(LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    span = min(shingle, n)
    out = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        out = mixed(out * MIX[2] + each[k : n - span + 1 + k])
    return np.unique(out)


def donor_table(bins: int = BINS, probes: int = PROBES) -> np.ndarray:
    """The bins that each empty bin asks, in order; the same for all documents."""
    asked = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(probes) + np.arange(probes, dtype=np.uint64)[None, :]
    return (mixed(mixed(asked + np.uint64(SEED))) % np.uint64(bins)).astype(np.int16)


def signature(items: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """The least hash of each bin; ``items`` is sorted, not empty, and its high bits name the bin."""
    bins = donors.shape[0]
    place = ((items >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    filled = np.zeros(bins, bool)
    out = np.zeros(bins, np.uint64)
    at = place[first].astype(np.int64)
    filled[at], out[at] = True, items[first]
    empty, seen, step = np.flatnonzero(~filled), 0, 64
    while len(empty) and seen < donors.shape[1]:
        asked = donors[empty, seen : seen + step]
        found = filled[asked]
        pick = found.argmax(axis=1)
        hit = found[np.arange(len(empty)), pick]
        out[empty[hit]] = out[asked[hit, pick[hit]]]
        empty, seen, step = empty[~hit], seen + step, 2 * step
    if len(empty):
        out[empty] = out[at[np.searchsorted(at, empty) % len(at)]]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) of bucket names, the number of the band mixed in."""
    cut = signatures.reshape(-1, bands, rows)
    keys = np.broadcast_to(mixed(np.arange(bands, dtype=np.uint64) + np.uint64(SEED)), cut.shape[:2]).copy()
    for k in range(rows):
        keys = mixed(keys * MIX[2] + cut[:, :, k])
    return keys


def parity_sketch(items: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """The parity of the number of items in each of ``64 * words`` cells: two sketches differ in no more cells than
    their sets in items."""
    cells = np.bincount((items % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").view(np.uint64)


def alike(n_a, n_b, shared, percent: int):
    """Whether the similarity of two sets reaches the threshold."""
    return 100 * shared >= percent * (n_a + n_b - shared)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"), F.xxhash64(text_of()).alias("text_hash"))


def with_signatures(docs: DataFrame, shingle: int = 2, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id, keys): the set's size and hash and the buckets of its bands."""

    def run(batches):
        hashes, donors = WordHashes(), donor_table(bands * rows)
        for batch in batches:
            sizes, names, signed = [], [], np.zeros((batch.num_rows, bands * rows), np.uint64)
            for k, text in enumerate(batch["text"].to_pylist()):
                items = shingle_set(text, shingle, hashes)
                sizes.append(len(items))
                names.append(xxhash.xxh3_64_intdigest(items.tobytes(), SEED))
                if len(items):
                    signed[k] = signature(items, donors)
            keys = band_keys(signed, bands, rows).view(np.int64)
            cuts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands)
            columns = [batch["doc_id"], batch["text_hash"], pa.array(sizes, pa.int64()), pa.array(np.array(names, np.uint64).view(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(keys.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_id", "keys"])

    return _keyed(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_id long, keys array<long>")


def with_sets(docs: DataFrame, shingle: int = 2) -> DataFrame:
    """(set_id, n, items, sketch): full sets and parity sketches, as bytes."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, shingle, hashes) for t in batch["text"].to_pylist()]
            names = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            sketches = pa.array([parity_sketch(s).tobytes() for s in sets], pa.binary())
            columns = [pa.array(names), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), sketches]
            yield pa.RecordBatch.from_arrays(columns, ["set_id", "n", "items", "sketch"])

    return _keyed(docs).mapInArrow(run, "set_id long, n long, items binary, sketch binary")


def _confirmed(batches, percent: int):
    """The edges of each star that hold; rows are sorted, a centre (b null) before its members."""
    star, centre = None, None
    for batch in batches:
        left, right = [], []
        members = zip(*(batch[c].to_pylist() for c in ("a", "salt", "b", "items")))
        for a, salt, b, items in members:
            mine = np.frombuffer(items, np.uint64)
            if b is None:
                star, centre = (a, salt), mine
                continue
            if star != (a, salt):
                raise ValueError("a star without its centre")
            small, large = min(len(mine), len(centre)), max(len(mine), len(centre))
            if 100 * small >= percent * large:
                at = np.searchsorted(centre, mine)
                at[at == len(centre)] = 0
                if alike(len(mine), len(centre), int((centre[at] == mine).sum()), percent):
                    left.append(a)
                    right.append(b)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def confirm(edges: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The edges (a, b) whose full sets reach the threshold. Stars of many members are split, each part with its centre."""
    parts = edges.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    placed = edges.join(parts, "a").withColumn("salt", F.pmod(F.hash("b"), "parts"))
    members = placed.join(sets.select(F.col("set_id").alias("b"), "items"), "b").select("a", "salt", "b", "items")
    used = placed.select("a", "salt").distinct()
    centres = used.join(sets.select(F.col("set_id").alias("a"), "items"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "items")
    rows = members.unionByName(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(lambda batches: _confirmed(batches, percent), "a long, b long")


def _crossing(batches, percent: int, most: int):
    """Pairs of members of one bucket in different components that the sketches do not rule out: for each two
    components the ``most`` nearest, and whether there were more."""
    for table in whole_groups(batches, ["key", "low", "high"]):
        keys = [table[c].to_numpy() for c in ("key", "low", "high", "root", "n", "set_id")]
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(table.num_rows, -1)
        change = np.zeros(table.num_rows, bool)
        for k in keys[:3]:
            change[1:] |= k[1:] != k[:-1]
        for part in np.split(np.arange(table.num_rows), np.flatnonzero(change)):
            root, n, ids = (k[part] for k in keys[3:])
            rows, found = sketches[part], []
            for i in range(len(part) - 1):
                # rows of a bucket are sorted by size: beyond some size no set can reach the threshold
                end = np.searchsorted(n, n[i] * 100 // percent, side="right")
                other = np.arange(i + 1, end)
                other = other[root[other] != root[i]]
                apart = np.bitwise_count(rows[other] ^ rows[i]).sum(axis=1, dtype=np.int64)
                near = (100 + percent) * apart <= (100 - percent) * (n[other] + n[i])
                if near.any():
                    found.append((np.full(near.sum(), i), other[near], apart[near]))
            if not found:
                continue
            i, j, apart = (np.concatenate(x) for x in zip(*found))
            low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
            order = np.lexsort((apart, high, low))
            i, j, low, high = (x[order] for x in (i, j, low, high))
            fresh = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            rank = np.arange(len(i)) - np.maximum.accumulate(np.where(fresh, np.arange(len(i)), 0))
            kept = rank < most
            a, b = np.minimum(ids[i], ids[j])[kept], np.maximum(ids[i], ids[j])[kept]
            key, more = np.full(len(a), keys[0][part[0]]), np.full(len(a), bool((~kept).any()))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b), pa.array(more)], ["key", "a", "b", "more"])


def _crossing_pairs(rows: DataFrame, roots: DataFrame, sketches: DataFrame, percent: int, most: int) -> DataFrame:
    """(key, a, b, more) over the buckets whose members lie in different components."""
    labelled = rows.join(roots, rows["set_id"] == roots["node"], "left").select("key", "set_id", F.coalesce("root", "set_id").alias("root"))
    labelled = stored(labelled, "labelled-buckets")
    open_buckets = labelled.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("members")).filter("x <> y")
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    own = F.pmod(F.hash("set_id"), tiles)
    met = F.explode(F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.least(own, t).alias("low"), F.greatest(own, t).alias("high"))))
    units = labelled.join(open_buckets, "key").withColumn("tile", met).select("key", "tile.low", "tile.high", "set_id", "root")
    placed = units.join(sketches, "set_id").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "n", "set_id")
    return placed.mapInArrow(lambda batches: _crossing(batches, percent, most), "key long, a long, b long, more boolean")


def similar_sets(classes: DataFrame, docs: DataFrame, shingle: int = 2, percent: int = 80, most: int = 8) -> DataFrame:
    """(node, root) of the sets that are linked to another one.

    ``classes`` holds one row a set: set_id, keys, and doc_id and text_hash of a document that has it.
    """
    rows = classes.select(F.explode("keys").alias("key"), "set_id")
    shared = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("set_id").alias("a")).filter("members > 1")
    met = stored(rows.join(shared, "key"), "bucket-members")
    edges = stored(met.filter("set_id <> a").select("a", F.col("set_id").alias("b")).distinct(), "stars")
    needed = edges.select(F.col("a").alias("set_id")).unionByName(edges.select(F.col("b").alias("set_id"))).distinct()
    holders = classes.select("set_id", "doc_id", "text_hash").join(needed, "set_id").select("doc_id", "text_hash")
    texts = boxed(docs.select("doc_id", "text")).join(holders, same_document(), "left_semi").select("row.*")
    sets = stored(with_sets(texts, shingle).dropDuplicates(["set_id"]), "sets")
    links = stored(confirm(edges, sets, percent), "links")
    larger = met.filter("members > 2").select("key", "set_id")  # a star of two has no other pair
    sketches = sets.select("set_id", "n", "sketch")
    while True:
        roots = connected_components(links)
        found = stored(_crossing_pairs(larger, roots, sketches, percent, most), "crossing")
        again = found.agg(F.max("more")).first()[0]
        if again is None:  # no pair is left
            return roots
        extra = confirm(found.select("a", "b").distinct(), sets, percent)
        links = stored(links.unionByName(extra), "links")
        if not again:  # all pairs that were left are confirmed or refuted now
            return connected_components(links)
        larger, most = stored(larger.join(found.filter("more").select("key").distinct(), "key", "left_semi"), "open-buckets"), 64 * most


def near_duplicate_sets(docs: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, text_hash, n_shingles, component_id.

    Documents are linked at a Jaccard similarity of ``percent`` or more of their sets of word shingles; a text of
    fewer words is one shingle. ``component_id`` is the least doc_id (not null) of all that are reachable. Equal sets
    are one node, known by a 64-bit hash, so copies form no pairs. A document without words or text is linked with
    nothing and is its own component. Repeated rows and null ids keep one row each; an empty table gives an empty
    result; only ``doc_id`` and ``text`` are read.
    """
    members = stored(with_signatures(docs, shingle), "signatures")
    worded = members.filter("n_shingles > 0")
    holder = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    classes = worded.groupBy("set_id").agg(F.min(holder).alias("h"), F.min("doc_id").alias("first_id"), F.any_value("keys").alias("keys"))
    classes = stored(classes.select("set_id", "h.doc_id", "h.text_hash", "first_id", "keys"), "classes")
    roots = similar_sets(classes, docs, shingle, percent)
    grouped = stored(classes.join(roots, classes["set_id"] == roots["node"], "left").select("set_id", "first_id", F.coalesce("root", "set_id").alias("group")), "groups")
    labels = grouped.join(grouped.groupBy("group").agg(F.min("first_id").alias("component_id")), "group").select("set_id", "component_id")
    found = worded.join(labels, "set_id").select("doc_id", "text_hash", "n_shingles", "component_id")
    alone = members.filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone)
