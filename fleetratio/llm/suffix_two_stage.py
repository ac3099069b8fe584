"""Substring dedup over suffix arrays built by two-stage sorting.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller doc_id.

Bringing together. The least hash of the k-byte strings inside a 50-byte string is its anchor: equal strings
have equal anchors, and only one byte in seventeen starts a new one. Anchors are shuffled packed, six bytes each;
those that two different texts have name the regions worth sorting, and regions with one anchor meet in a task.
Texts are moved once, into a table bucketed by document, with which later joins need no second move.

Sorting. A task lays its regions end to end. Suffixes smaller than their successor are sorted directly; the rest,
each greater than its successor, are induced by scanning the buckets of first bytes upwards, where every
successor has its place already. Common prefixes of neighbours in the finished order show the equal strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetratio.llm.common import bucketed, text_of, whole_groups

LENGTH = 50
#: Bytes hashed for an anchor; a string has LENGTH - KGRAM + 1 of them.
KGRAM = 20
#: Starts in a region at most, so that their marks fit a long; a longer stretch with one anchor makes several regions.
STARTS = 32
#: Regions with one anchor that are sorted together; beyond it each string goes to one of several tasks by its hash.
TILE = 4096
#: Slices of the hash range for each shuffle partition, so that hashing them to partitions evens out.
SLICES = 4
#: Regions sorted at a time, more only where one anchor has more.
CHUNK = 8_192
#: Bytes of a text hashed at a time.
PIECE = 1 << 18
LAST_ID = 2**63 - 1


def string_anchors(data: bytes, length: int = LENGTH, kgram: int = KGRAM) -> np.ndarray:
    """Anchor, 48 bits, of the string at every start."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    n, size, factor = len(x), 1, np.array([0x100000001B3], np.uint64)
    doubled = {1: (x, factor)}
    while 2 * size <= kgram:  # hashes of twice the length from two halves
        doubled[2 * size] = (x := x[:-size] * factor + x[size:], factor := factor * factor)
        size *= 2
    hashed, at = np.zeros(n - kgram + 1, np.uint64), 0
    for size in sorted(doubled, reverse=True):
        if kgram & size:
            part, factor = doubled[size]
            hashed = hashed * factor + part[at : at + len(hashed)]
            at += size
    hashed ^= hashed >> np.uint64(31)
    hashed *= np.uint64(0x9E3779B97F4A7C15)
    hashed >>= np.uint64(16)
    width, size = length - kgram + 1, 1
    least = hashed
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    starts = n - length + 1
    return np.minimum(least[:starts], least[width - size : width - size + starts])


def pieces_of(data: bytes, length: int):
    """(offset, bytes) pieces that overlap so that every string lies in one."""
    for at in range(0, max(len(data) - length + 1, 0), PIECE):
        yield at, data[at : at + PIECE + length - 1]


def slice_of(values: np.ndarray, slices: int) -> np.ndarray:
    """Slice of each value by a hash of it: anchors are minima, most of them small."""
    return ((values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1).astype(np.uint64)


def _anchor_rows(batches, slices: int, length: int):
    """Anchors of a batch of documents, one row for each slice of the hash range."""
    for batch in batches:
        ids, hashes = batch["id"].to_numpy(), batch["text_hash"].to_numpy()
        each = []
        for text in batch["text"].to_pylist():
            found = [np.unique(string_anchors(piece, length)) for _, piece in pieces_of(text.encode(), length)]
            each.append(np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64))
        anchor = np.concatenate(each)
        doc = np.repeat(np.arange(len(each)), [len(e) for e in each])
        part = slice_of(anchor, slices)
        order = np.argsort(part, kind="stable")  # documents stay in order within a slice
        anchor, doc, part = anchor[order], doc[order], part[order]
        bounds = np.searchsorted(part, np.arange(slices + 1))
        rows = []
        for s in range(slices):
            a, b = bounds[s], bounds[s + 1]
            if a < b:
                who, counts = np.unique(doc[a:b], return_counts=True)
                rows.append((s, _packed(anchor[a:b]), ids[who].tobytes(), hashes[who].tobytes(), counts.astype(np.int32).tobytes()))
        columns = list(zip(*rows)) if rows else [[], [], [], [], []]
        types = [pa.int32()] + [pa.binary()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["slice", "anchors", "ids", "hashes", "counts"])


def _squeezed(array) -> bytes:
    data = array if isinstance(array, bytes) else np.ascontiguousarray(array).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _released(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _shared_anchors(batches, homes: int):
    """For the first document of each text its anchors that another text has too, and the tiles each needs.

    One row for each home, a part of the documents, to which the anchors go back.
    """
    for table in whole_groups(batches, ["slice"]):
        cuts = np.flatnonzero(np.diff(table["slice"].to_numpy())) + 1
        for a, b in zip([0, *cuts], [*cuts, table.num_rows]):
            part = table.slice(a, b - a)
            read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in part[name].to_pylist()])
            counts = read("counts", np.int32)
            anchor = np.concatenate([_unpacked(x) for x in part["anchors"].to_pylist()])
            doc, text = np.repeat(read("ids", np.int64), counts), np.repeat(read("hashes", np.int64), counts)
            order = np.lexsort((doc, text, anchor))
            anchor, doc, text = anchor[order], doc[order], text[order]
            first = np.ones(len(anchor), bool)
            first[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            anchor, doc, text = anchor[first], doc[first], text[first]
            _, run, size = np.unique(anchor, return_inverse=True, return_counts=True)
            many = size[run] > 1
            anchor, doc, text, tiles = anchor[many], doc[many], text[many], -(-size[run][many] // TILE)
            home = slice_of((doc ^ text).view(np.uint64), homes)
            order = np.lexsort((text, doc, home))
            anchor, doc, text, tiles, home = (x[order] for x in (anchor, doc, text, tiles, home))
            used, starts = np.unique(home, return_index=True)
            bounds = [*zip(starts.tolist(), [*starts[1:].tolist(), len(home)])]
            packed = [[_squeezed(x[y:z]) for y, z in bounds] for x in (doc, text, anchor, tiles.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32())] + [pa.array(p, pa.binary()) for p in packed], ["home", "ids", "hashes", "anchors", "tiles"])


def _per_document(batches):
    """One row for each document from the rows of its home."""
    for table in whole_groups(batches, ["home"]):
        read = lambda name, kind: np.concatenate([np.frombuffer(_released(x), kind) for x in table[name].to_pylist()])
        doc, text, anchor, tiles = read("ids", np.int64), read("hashes", np.int64), read("anchors", np.uint64), read("tiles", np.int32)
        order = np.lexsort((anchor, text, doc))
        doc, text, anchor, tiles = doc[order], text[order], anchor[order], tiles[order]
        head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])))
        bounds = [*zip(head.tolist(), [*head[1:].tolist(), len(doc)])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[head]), pa.array(text[head]), pa.array([_packed(anchor[x:y]) for x, y in bounds], pa.binary()), pa.array([tiles[x:y].tobytes() for x, y in bounds], pa.binary())],
            ["id", "text_hash", "anchors", "tiles"],
        )


REGION_ROWS = "slice int, body binary, ids binary, hashes binary, starts binary, ns binary"


def _region_rows(batches, slices: int, length: int):
    """Regions of documents around shared anchors, one row for each slice of a batch.

    A region that a document with a smaller id in the batch has too need not be sorted: all its strings go. Such
    regions form a row without bytes.
    """
    for number, batch in enumerate(batches):
        seen: dict[int, int] = {}
        shipped, settled = [], []
        ids, hashes, texts = (batch[c].to_pylist() for c in ("id", "text_hash", "text"))
        blobs, tile_blobs = batch["anchors"].to_pylist(), batch["tiles"].to_pylist()
        for k in sorted(range(len(ids)), key=lambda k: ids[k]):
            wanted, tiles = _unpacked(blobs[k]), np.frombuffer(tile_blobs[k], np.int32)
            for offset, piece in pieces_of(texts[k].encode(), length):
                anchor = string_anchors(piece, length)
                cut = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                at = np.minimum(np.searchsorted(wanted, anchor[cut]), len(wanted) - 1)
                hit = wanted[at] == anchor[cut]
                values = anchor[cut[hit]]
                bounds = zip(cut[hit].tolist(), np.append(cut[1:], len(anchor))[hit].tolist())
                for (a, b), t, value, home in zip(bounds, tiles[at[hit]].tolist(), values.tolist(), slice_of(values, slices).tolist()):
                    step = STARTS if t == 1 else 1
                    for s in range(a, b, step):
                        e = min(b, s + step)
                        region = piece[s : e + length - 1]
                        same = xxhash.xxh3_64_intdigest(region)
                        if seen.setdefault(same, ids[k]) < ids[k]:
                            settled.append((ids[k], hashes[k], offset + s, e - s))
                        else:
                            part = home if t == 1 else xxhash.xxh3_64_intdigest(b"%d %d" % (value, same % t)) % slices
                            shipped.append((part, ids[k], hashes[k], offset + s, e - s, region))
        rows = []
        shipped.sort(key=lambda r: r[:2])
        placed = np.array([r[0] for r in shipped], np.int64)
        bounds = np.searchsorted(placed, np.arange(slices + 1)).tolist()
        for s in range(slices):
            part = shipped[bounds[s] : bounds[s + 1]]
            if part:
                rows.append((s, _squeezed(b"".join(r[5] for r in part)), *_columns([r[1:5] for r in part])))
        if settled:
            rows.append((number % slices, None, *_columns(settled)))
        columns = list(zip(*rows)) if rows else [[]] * 6
        types = [pa.int32()] + [pa.binary()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["slice", "body", "ids", "hashes", "starts", "ns"])


def _columns(rows: list[tuple]) -> list[bytes]:
    return [_squeezed(np.array([r[k] for r in rows], kind)) for k, kind in enumerate((np.int64, np.int64, np.int64, np.int8))]


def two_stage_ranks(text: np.ndarray, ends: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every wanted suffix (and of those it is induced from), -1 elsewhere.

    ``ends`` gives for each place the end of its region; a region's end sorts before all bytes. Suffixes are
    told apart by ``depth`` bytes at least.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    place = np.arange(n)
    inner = place + 1 < ends
    step = np.where(inner, padded[1 : n + 1].astype(np.int16) - text, -1)  # against the end of the region: falling
    turn = np.flatnonzero(step != 0)  # a run of equal bytes rises or falls with the step that ends it
    rising = step[turn[np.searchsorted(turn, place)]] > 0
    # places that are needed: wanted ones, and from each falling one its successor, up to a rising one or the region's last
    need, fresh = wanted.copy(), np.flatnonzero(wanted & ~rising & inner) + 1
    while len(fresh):
        fresh = fresh[~need[fresh]]
        need[fresh] = True
        fresh = fresh[~rising[fresh] & inner[fresh]] + 1
    rank = np.full(n, -1, np.int64)

    # stage one: sort the rising suffixes by their bytes
    direct = np.flatnonzero(need & rising)
    reach = np.minimum(ends[direct] - direct, depth)
    keys = np.lib.stride_tricks.sliding_window_view(padded, -(-depth // 8) * 8)[direct]
    keys[np.arange(keys.shape[1])[None, :] >= reach[:, None]] = 0
    words = keys.view(">u8")
    direct = direct[np.lexsort([reach] + [words[:, k] for k in range(words.shape[1] - 1, -1, -1)])]

    # stage two: scan the buckets of first bytes; falling suffixes stand before the rising ones of their bucket
    falling = np.flatnonzero(need & ~rising)
    by_byte = falling[np.argsort(text[falling], kind="stable")]
    fall_at, rise_at = np.searchsorted(text[by_byte], np.arange(257)), np.searchsorted(text[direct], np.arange(257))
    base = 0
    for byte in np.flatnonzero(np.diff(fall_at) + np.diff(rise_at)).tolist():
        waiting = by_byte[fall_at[byte] : fall_at[byte + 1]]
        while len(waiting):
            after = np.where(inner[waiting], rank[np.minimum(waiting + 1, n - 1)], -2)
            ready = after != -1
            chosen = waiting[ready]
            # equal successors keep equal order; a later round holds longer runs of this byte, which sort higher
            chosen = chosen[np.argsort(after[ready], kind="stable")]
            rank[chosen] = base + np.arange(len(chosen))
            base += len(chosen)
            waiting = waiting[~ready]
        rises = direct[rise_at[byte] : rise_at[byte + 1]]
        rank[rises] = base + np.arange(len(rises))
        base += len(rises)
    return rank


def _marks(regions: list[bytes], doc: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each region the starts whose string has a document before the region's own, as bits."""
    sizes = starts + length - 1
    text = np.frombuffer(b"".join(regions), np.uint8)
    begin = np.cumsum(sizes) - sizes
    region = np.repeat(np.arange(len(regions)), starts)
    offset = np.arange(len(region)) - np.repeat(np.cumsum(starts) - starts, starts)
    place = begin[region] + offset
    wanted = np.zeros(len(text), bool)
    wanted[place] = True
    order = np.argsort(two_stage_ranks(text, np.repeat(begin + sizes, sizes), wanted, length)[place])
    strings = np.lib.stride_tricks.sliding_window_view(text, length)[place[order]]
    differ = strings[1:] != strings[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)  # prefixes of neighbours
    head = np.append(True, common < length)
    run = np.cumsum(head) - 1
    least = np.minimum.reduceat(doc[region[order]], np.flatnonzero(head))[run]
    before = np.zeros(len(place), bool)
    before[order] = least < doc[region[order]]
    return np.bitwise_or.reduceat(before.astype(np.int64) << offset, np.cumsum(starts) - starts)


def _sorted_slices(batches, length: int):
    """(id, text_hash, start, marks) of the regions that lose a string; each slice is cut between anchors."""

    def rows(doc, text, start, marks):
        hit = marks != 0
        return pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (doc, text, start, marks)], ["id", "text_hash", "start", "marks"])

    for table in whole_groups(batches, ["slice"]):
        cuts = np.flatnonzero(np.diff(table["slice"].to_numpy())) + 1
        for a, b in zip([0, *cuts], [*cuts, table.num_rows]):
            part = table.slice(a, b - a).to_pylist()
            read = lambda r, name, kind: np.frombuffer(_released(r[name]), kind)
            regions, kept, anchors = [], [], []
            for r in part:
                columns = [read(r, "ids", np.int64), read(r, "hashes", np.int64), read(r, "starts", np.int64), read(r, "ns", np.int8).astype(np.int64)]
                if r["body"] is None:
                    yield rows(*columns[:3], (np.int64(1) << columns[3]) - 1)
                    continue
                body, ends = _released(r["body"]), np.cumsum(columns[3] + length - 1)
                regions += [body[x:y] for x, y in zip([0, *ends.tolist()], ends.tolist())]
                anchors.append(string_anchors(body, length)[np.append(0, ends[:-1])])
                kept.append(columns)
            if not regions:
                continue
            doc, text, start, n = (np.concatenate(c) for c in zip(*kept))
            anchor = np.concatenate(anchors)
            order = np.argsort(anchor, kind="stable")
            new = np.flatnonzero(np.append(True, np.diff(anchor[order]) != 0))
            at = 0
            while at < len(order):
                after = new[np.searchsorted(new, at + CHUNK) :]
                end = int(after[0]) if len(after) else len(order)
                chosen = order[at:end]
                marks = _marks([regions[k] for k in chosen], doc[chosen], n[chosen], length)
                yield rows(doc[chosen], text[chosen], start[chosen], marks)
                at = end


def _cut(batches, length: int):
    """What is left of each document: (id, text_hash, n_removed, n_spans, kept_sha256)."""
    for batch in batches:
        rows = []
        for text, starts, marks in zip(*(batch[c].to_pylist() for c in ("text", "starts", "marks"))):
            data = text.encode()
            edge = np.zeros(len(data) + 1, np.int32)
            first, bits = np.array(starts, np.int64), np.array(marks, np.int64)
            which, at = np.nonzero((bits[:, None] >> np.arange(STARTS)[None, :]) & 1)
            begin = np.unique(first[which] + at)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["text_hash"], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
            ["id", "text_hash", "n_removed", "n_spans", "kept_sha256"],
        )


def remove_repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty. A document without id counts as later than all others. Documents with one id do not
    count as earlier than each other. Of exact copies only the first is sorted: every byte of the others goes, if
    the text has 50 bytes at all. An empty table gives an empty result; other columns are not read. Texts and
    regions are known by 64-bit hashes.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash")
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = SLICES * partitions

    def by_slice(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions, "slice").sortWithinPartitions("slice")

    texts = keyed.select("id", "text_hash", "text")
    packed = texts.mapInArrow(lambda b: _anchor_rows(b, slices, length), "slice int, anchors binary, ids binary, hashes binary, counts binary")
    shared = by_slice(packed).mapInArrow(lambda b: _shared_anchors(b, partitions), "home int, ids binary, hashes binary, anchors binary, tiles binary")
    back = shared.repartition(partitions, "home").sortWithinPartitions("home")
    per_doc = back.mapInArrow(_per_document, "id long, text_hash long, anchors binary, tiles binary")
    candidates = bucketed(texts.join(per_doc, ["id", "text_hash"]), ["id", "text_hash"], partitions)
    regions = candidates.mapInArrow(lambda b: _region_rows(b, slices, length), REGION_ROWS)
    hit = by_slice(regions).mapInArrow(lambda b: _sorted_slices(b, length), "id long, text_hash long, start long, marks long")
    per_text = hit.groupBy("id", "text_hash").agg(F.collect_list("start").alias("starts"), F.collect_list("marks").alias("marks"))
    cut = (
        candidates.select("id", "text_hash", "text")
        .join(per_text, ["id", "text_hash"])
        .mapInArrow(lambda b: _cut(b, length), "id long, text_hash long, n_removed long, n_spans long, kept_sha256 string")
        .dropDuplicates(["id", "text_hash"])
    )

    base = keyed.select("doc_id", "id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    firsts = base.groupBy("sha").agg(F.min("id").alias("first_id"))
    joined = base.join(firsts, "sha").join(cut, ["id", "text_hash"], "left")
    copy = (F.col("first_id") < F.col("id")) & (F.col("n_bytes") >= length)
    pick = lambda full_value, own, none: F.when(copy, full_value).otherwise(F.coalesce(own, none))
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), zero).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.col("n_spans"), zero).alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
    )
