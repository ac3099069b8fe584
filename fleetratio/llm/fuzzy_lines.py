"""Fuzzy line dedup: MinHash signatures of character shingles, banding, exact Jaccard, union-find.

Lines that are equal meet by their hash. Different lines get a signature of minimum hashes over their character
shingles; lines that share a band are candidates. Each candidate is first verified against the least line of
its bucket; the lines of a bucket that this leaves in different components are verified against each other in
tasks of bounded size, where sketches first rule out what cannot be similar. All links have an exact Jaccard similarity of the threshold or more. Of each component
the first line in the corpus stays.

A line is known by a 64-bit hash: among n lines two different ones are taken for one with a chance of n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetratio.llm.common import WORD, Forest, boxed, same_document, stored, text_of, whole_groups
from fleetratio.llm.components import connected_components
from fleetratio.operators.quality import possible_members

SHINGLE = 7
THRESHOLD = 0.8
#: Ten bands of four: two lines at similarity 0.8 share a band with a chance of 0.995, at 0.9 of 0.99997.
BANDS, ROWS = 10, 4
#: Lines hashed in one go, few enough for the processor's cache.
BLOCK = 256
#: Characters of the pairs compared in one go.
PAIR_CHARS = 1 << 18
#: Parts the buckets are dealt to, a power of two up to 2^16: rows of a part travel packed, some dozens in one row of Spark.
PARTS = 1 << 12
#: Lines of one bucket compared in one task; larger buckets are cut into tiles that meet pairwise.
TILE = 1024
#: 64-bit words of the sketch of a line: 2048 cells, enough to rule out lines of some thousand characters.
SKETCH_WORDS = 32


def shingle_hashes(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of all lines, one line behind the other, and how many each line has."""
    pad = "\0" * (shingle - 1)
    chars = np.frombuffer((pad.join(lines) + pad).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    hashed = np.zeros(len(chars) - shingle + 1, np.uint64)
    for k in range(shingle):
        hashed = hashed * np.uint64(0x100000001B3) + chars[k : len(chars) - shingle + 1 + k]
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    counts = np.maximum(lengths - shingle + 1, 1)
    starts = np.concatenate(([0], np.cumsum(lengths + shingle - 1)[:-1]))
    cuts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return hashed[np.arange(counts.sum()) + np.repeat(starts - cuts, counts)], counts


def shingle_codes(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each character shingle of all lines, how many each line has, and which lines are coded.

    The numbers are equal just where the shingles are: each character has its own bits. There is room for the most
    frequent characters (511 in shingles of seven); a line with any other is not coded.
    """
    bits = 64 // shingle
    pad = "\0" * (shingle - 1)
    chars = np.frombuffer((pad.join(lines) + pad).encode("utf-32-le"), "<u4")
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate(([0], np.cumsum(lengths + shingle - 1)[:-1]))
    own = np.ones(len(chars), bool)
    own[(starts + lengths)[:, None] + np.arange(shingle - 1)] = False
    often = np.bincount(chars[own])
    kinds = np.flatnonzero(often)
    kinds = kinds[np.argsort(-often[kinds], kind="stable")][: (1 << bits) - 1]
    code = np.zeros(max(len(often), 1), np.uint64)
    code[kinds] = np.arange(1, len(kinds) + 1)
    coded = np.ones(len(lines), bool)
    if len(kinds) < np.count_nonzero(often):
        at = np.flatnonzero(own & (code[chars] == 0))
        coded[np.searchsorted(starts, at, side="right") - 1] = False
    # padding stays 0, so a line shorter than a shingle equals no other
    chars = np.where(own, code[chars], np.uint64(0))
    packed = np.zeros(len(chars) - shingle + 1, np.uint64)
    for k in range(shingle):
        packed = (packed << np.uint64(bits)) | chars[k : len(chars) - shingle + 1 + k]
    counts = np.maximum(lengths - shingle + 1, 1)
    cuts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return packed[np.arange(counts.sum()) + np.repeat(starts - cuts, counts)], counts, coded


def _sorted_fresh(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sorts each line's part of ``values`` in place; which of the values are the first of their kind in their line."""
    cuts = [0, *ends.tolist()]
    for at, end in zip(cuts, cuts[1:]):
        values[at:end].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[ends[:-1]] = True
    return fresh


def line_signatures(lines: list[str], shingle: int, functions: int) -> np.ndarray:
    """Minimum of each hash function over the character shingles of each line; a short line is one shingle."""
    rng = np.random.default_rng(1)
    factors = (rng.integers(0, 1 << 31, functions, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, functions, dtype=np.uint32)
    out = np.empty((len(lines), functions), np.uint32)
    for at in range(0, len(lines), BLOCK):
        hashed, counts = shingle_hashes(lines[at : at + BLOCK], shingle)
        cuts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        values = (hashed >> np.uint64(32)).astype(np.uint32)
        for f in range(functions):
            out[at : at + len(counts), f] = np.minimum.reduceat(values * factors[f] + shifts[f], cuts)
    return out


def line_sketches(lines: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of the shingle sets and bounds of their sizes from above.

    A sketch tells for each of its cells whether an odd number of shingles fall there: two sketches differ in no more
    cells than the sets in shingles, also where shingles share a hash.
    """
    cells = 64 * SKETCH_WORDS
    sketches, sizes = np.empty((len(lines), SKETCH_WORDS), np.uint64), np.empty(len(lines), np.int64)
    for at in range(0, len(lines), BLOCK):
        hashed, counts = shingle_hashes(lines[at : at + BLOCK], shingle)
        row = np.repeat(np.arange(len(counts)), counts)
        fresh = _sorted_fresh(hashed, np.cumsum(counts))
        cell = (hashed[fresh] >> np.uint64(32)).astype(np.int64) % cells
        odd = np.bincount(row[fresh] * cells + cell, minlength=len(counts) * cells) & 1
        sketches[at : at + len(counts)] = np.packbits(odd.astype(np.uint8).reshape(len(counts), cells), axis=1).view(np.uint64)
        sizes[at : at + len(counts)] = counts
    return sketches, sizes


def band_buckets(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket for each line and band."""
    out = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signatures), b + 1, np.uint64)
        for r in range(rows):
            h = (h ^ signatures[:, b * rows + r]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        out[:, b] = h
    return out.view(np.int64)


def shingles(line: str, shingle: int) -> set[str]:
    return {line[i : i + shingle] for i in range(max(1, len(line) - shingle + 1))}


def similar(a: set, b: set, threshold: float) -> bool:
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


def similar_pairs(left: list[str], right: list[str], shingle: int, threshold: float) -> np.ndarray:
    """Which of the pairs of lines are ``similar``: exactly, by sorted numbers that stand for the shingles."""
    out = np.zeros(len(left), bool)
    chars = np.cumsum([len(x) + len(y) for x, y in zip(left, right)])
    at = 0
    while at < len(left):
        before = chars[at - 1] if at else 0
        end = max(int(np.searchsorted(chars, before + PAIR_CHARS, side="right")), at + 1)
        place: dict[str, int] = {}
        pairs = [(place.setdefault(x, len(place)), place.setdefault(y, len(place))) for x, y in zip(left[at:end], right[at:end])]
        lines = list(place)
        codes, counts, coded = shingle_codes(lines, shingle)
        ends = np.cumsum(counts)
        fresh = _sorted_fresh(codes, ends)
        codes, ends = codes[fresh], np.cumsum(fresh)[ends - 1]
        cuts, coded = [0, *ends.tolist()], coded.tolist()
        for k, (i, j) in enumerate(pairs, at):
            if not (coded[i] and coded[j]):
                out[k] = similar(shingles(lines[i], shingle), shingles(lines[j], shingle), threshold)
                continue
            a, b = cuts[i + 1] - cuts[i], cuts[j + 1] - cuts[j]
            if min(a, b) >= threshold * max(a, b):
                met = np.concatenate((codes[cuts[i] : cuts[i + 1]], codes[cuts[j] : cuts[j + 1]]))
                met.sort()
                both = np.count_nonzero(met[1:] == met[:-1])
                out[k] = both >= threshold * (a + b - both) - 1e-9
        at = end
    return out


def corpus_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, place, line, content): the lines with a word; place counts all lines from 0."""
    text = text_of()
    each = docs.select(F.col("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("place", "content"))
    return each.filter(F.col("content").rlike(WORD)).withColumn("line", F.xxhash64("content"))


def _buckets(lines: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(part, packed): rows (bucket, line) of the bands of each line, as pairs of 64-bit numbers, by part of the buckets."""

    def run(batches):
        for batch in batches:
            signatures = line_signatures(batch["content"].to_pylist(), shingle, bands * rows)
            buckets = band_buckets(signatures, bands, rows)
            rows_of = np.stack((buckets.reshape(-1), np.repeat(batch["line"].to_numpy(), bands)), axis=1)
            part = _part(rows_of[:, 0])
            order = np.argsort(part, kind="stable")
            part, rows_of = part[order], rows_of[order]
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
            ends = np.append(cuts, len(part)).astype(np.int32) * 16
            packed = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(rows_of)])
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), packed], ["part", "packed"])

    return lines.select("line", "content").mapInArrow(run, "part int, packed binary")


def _part(buckets: np.ndarray) -> np.ndarray:
    return (buckets & (PARTS - 1)).astype(np.uint16)


def _crowded(batches):
    """Rows (bucket, line) from batches of (part, packed) sorted by part, where the bucket has another row.

    Of the part that a batch leaves open one row of each bucket is held, not the rows of a bucket.
    """
    held, told = np.empty((0, 2), np.int64), np.empty(0, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.frombuffer(b"".join(batch["packed"].to_pylist()), np.int64).reshape(-1, 2)
        rows, told = np.concatenate((held, rows)), np.append(told, np.zeros(len(rows), bool))
        order = np.argsort(rows[:, 0], kind="stable")  # a held row stays the first of its bucket
        rows, told = rows[order], told[order]
        again = np.zeros(len(rows), bool)
        again[1:] = rows[1:, 0] == rows[:-1, 0]
        many = again.copy()
        many[:-1] |= again[1:]
        out = rows[many & ~told]
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["bucket", "line"])
        keep = ~again & (_part(rows[:, 0]) == batch["part"][-1].as_py())
        held, told = rows[keep], (told | many)[keep]


def _shared(batches):
    """Rows of sorted (bucket, line), each once, whose bucket has another line, with the bucket's least line as leader.

    Of the bucket that a batch leaves open only its number, leader and last line are kept.
    """
    held, told = None, False
    for batch in batches:
        bucket, line = batch["bucket"].to_numpy(), batch["line"].to_numpy()
        fresh = np.ones(len(bucket), bool)
        fresh[1:] = (bucket[1:] != bucket[:-1]) | (line[1:] != line[:-1])
        if held and len(bucket):
            fresh[0] = (bucket[0], line[0]) != (held[0], held[2])
        bucket, line = bucket[fresh], line[fresh]
        if not len(bucket):
            continue
        goes_on = held is not None and bucket[0] == held[0]
        if goes_on:
            bucket, line = np.append(held[0], bucket), np.append(held[1], line)
        new = np.ones(len(bucket), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        leader = line[first][group]
        many = np.logical_or.reduceat(line != leader, first)[group]
        held, out = (bucket[-1], leader[-1], line[-1]), many.copy()
        out[0] &= not (goes_on and told)
        told = bool(many[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (bucket, line, leader)], ["bucket", "line", "leader"])


def _verified(pairs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            good = similar_pairs(batch["content_a"].to_pylist(), batch["content_b"].to_pylist(), shingle, threshold)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.select("a", "b", "content_a", "content_b").mapInArrow(run, "a long, b long")


def _cross_links(batches, shingle: int, threshold: float):
    """Links between the components of each group of rows (bucket, low, high, line, root, content, leader), as pairs of roots.

    Pairs with the bucket's leader have been verified before. Sketches rule out most of the others: sets of similarity
    t differ in at most (1 - t) / (1 + t) of the sum of their sizes. What is left is compared shingle by shingle.
    """
    slack = (1 - threshold) / (1 + threshold) + 1e-9
    for table in whole_groups(batches, ["bucket", "low", "high"]):
        change = np.zeros(table.num_rows, bool)
        for c in ("bucket", "low", "high"):
            key = table[c].to_numpy()
            change[1:] |= key[1:] != key[:-1]
        others = np.flatnonzero(table["line"].to_numpy() != table["leader"].to_numpy())
        group = np.cumsum(change)[others]
        contents = table["content"].take(pa.array(others)).to_pylist()
        names, node = np.unique(table["root"].to_numpy()[others], return_inverse=True)
        sketches, sizes = line_sketches(contents, shingle)
        forest = Forest(len(names))
        left, right = [], []
        # rows of a group lie side by side: first each meets its neighbour, then the row behind that, and so on
        rows, step = np.arange(len(others) - 1), 1
        while len(rows := rows[group[rows] == group[rows + step]]):
            i = rows[forest.label[node[rows]] != forest.label[node[rows + step]]]
            apart = np.bitwise_count(sketches[i] ^ sketches[i + step]).sum(axis=1, dtype=np.int64)
            i = i[apart <= slack * (sizes[i] + sizes[i + step])]
            if len(i):
                i = i[similar_pairs([contents[k] for k in i], [contents[k + step] for k in i], shingle, threshold)]
                i = i[forest.join(node[i], node[i + step])]
                left.extend(names[node[i]].tolist())
                right.extend(names[node[i + step]].tolist())
            step += 1
            rows = rows[rows + step < len(others)]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _each_once(lines: DataFrame) -> DataFrame:
    return lines.groupBy("line").agg(F.first("content").alias("content"))


def _contents_of(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, content) of the lines in ``wanted`` (distinct), each once.

    Few lines share a bucket: the others are left out by a bit set of the wanted hashes before contents are shuffled again.
    An inner join with the distinct hashes does the rest: Spark would move a semi-join before the bit set, with all contents.
    """
    return _each_once(possible_members(lines.select("line", "content"), wanted, "line")).join(wanted, "line")


def similar_line_classes(lines: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, root) of every line that has a similar but different line in ``lines`` (line, content).

    Lines shorter than a shingle are one shingle each. Repeated rows count once; an empty table gives an empty result.
    """
    # combined before the shuffle: a line that a third of the corpus repeats is banded once
    each = _each_once(lines)
    placed = _buckets(each, shingle, bands, rows).repartition("part").sortWithinPartitions("part")
    crowded = placed.mapInArrow(_crowded, "bucket long, line long").sortWithinPartitions("bucket", "line")
    shared = stored(crowded.mapInArrow(_shared, "bucket long, line long, leader long"), "line-buckets")
    wanted = shared.select("line").distinct()
    texts = stored(_contents_of(lines, wanted), "candidate-lines")

    stars = shared.filter("line <> leader").select(F.col("leader").alias("a"), F.col("line").alias("b")).distinct()
    with_a = stars.join(texts.withColumnRenamed("content", "content_a"), stars["a"] == F.col("line")).drop("line")
    with_both = with_a.join(texts.withColumnRenamed("content", "content_b"), with_a["b"] == F.col("line")).drop("line")
    links = stored(_verified(with_both, shingle, threshold), "star-links")
    roots = connected_components(links)

    labelled = stored(shared.join(roots, shared["line"] == roots["node"], "left").select("bucket", "line", F.coalesce("root", "line").alias("root")), "labelled-buckets")
    contents = labelled.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n"), F.expr("bit_xor(xxhash64(line))").alias("content"), F.min("line").alias("leader"))
    # of two lines one is the leader; of buckets with equal contents, which bands often make, one is looked at
    mixed = contents.filter("r0 <> r1 AND n > 2").groupBy("content", "n", "leader").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "leader")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.hash("line"), tiles)
    met = F.explode(F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(F.least(own, t).alias("low"), F.greatest(own, t).alias("high"))))
    units = labelled.join(mixed, "bucket").withColumn("t", met).select("bucket", "t.low", "t.high", "line", "root", "leader")
    loaded = units.join(texts, "line").select("bucket", "low", "high", "line", "root", "content", "leader")
    placed = loaded.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "line")
    crossing = placed.mapInArrow(lambda batches: _cross_links(batches, shingle, threshold), "a long, b long")
    # the links between components are few: only roots take part in the second union
    joined = connected_components(stored(crossing.distinct(), "root-links")).withColumnsRenamed({"node": "old", "root": "new"})
    moved = roots.join(joined, roots["root"] == joined["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    single = joined.join(roots, joined["old"] == roots["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return stored(moved.unionByName(single), "line-roots")


def duplicate_lines(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, removed): the places of the lines that go, for each document that loses one.

    The first line of a class stays: least doc_id (null last), then text hash, then place. Lines without a word
    always stay. Rows equal in doc_id and text are one document, to all of which the result applies.
    """
    lines = corpus_lines(docs)
    placed = stored(lines.select("doc_id", "text_hash", "place", "line"), "line-places")
    where = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash", "place")
    firsts = placed.groupBy("line").agg(F.min(where).alias("first"), F.count("*").alias("n"))
    roots = similar_line_classes(lines, shingle, threshold, bands, rows)
    classed = stored(
        firsts.join(roots, firsts["line"] == roots["node"], "left").filter("n > 1 OR root IS NOT NULL").select("line", "first", F.coalesce("root", "line").alias("root")), "line-classes"
    )
    keepers = classed.groupBy("root").agg(F.min("first").alias("keeper"))
    lookup = classed.join(keepers, "root").select("line", "keeper")
    gone = placed.join(lookup, "line").filter(~where.eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("place")).alias("removed"))


def line_report(docs: DataFrame, **settings) -> DataFrame:
    """One row for each document: doc_id, n_lines (with a word), n_removed, removed (places, comma-joined).

    Null and empty texts have no lines. An empty table gives an empty result; other columns are not read.
    """
    counted = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), F.size(F.filter(F.split(text_of(), "\n", -1), lambda x: x.rlike(WORD))).cast("long").alias("n_lines"))
    gone = duplicate_lines(docs, **settings)
    key = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_hash") == F.col("g.text_hash"))
    places = F.coalesce("removed", F.array().cast("array<int>"))
    return counted.alias("d").join(gone.alias("g"), key, "left").select("d.doc_id", "n_lines", F.size(places).cast("long").alias("n_removed"), F.concat_ws(",", places.cast("array<string>")).alias("removed"))


def drop_duplicate_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with their duplicate lines cut out of ``text``; columns and rows stay, a null text stays null."""
    joined = boxed(docs).join(duplicate_lines(docs, **settings), same_document(), "left")
    lines = F.split("row.text", "\n", -1)
    left = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("removed", i), x)), lambda x: x.isNotNull())
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")
