"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping windows. A window of w characters that occurs in a document with at most
k edits shares at least w + 1 - q (k + 1) of its q-grams with it, all on diagonals that differ by k at most. The
shared q-grams are counted in overlapping bands of diagonals; bands with enough of them are aligned, inside the
band, and count if the window fits with k edits.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetratio.llm.common import boxed, same_document, stored, text_of

Q, WINDOW, STEP, EDITS = 12, 80, 10, 5
#: Characters of the benchmark that are searched in one pass over the documents; a larger benchmark takes more passes.
BLOCK_CHARS = 2_000_000
#: Shared q-grams counted in one go.
HITS = 1 << 20
#: Characters of documents handled at a time in a task.
PIECE_CHARS = 1 << 20
WALL = 1000
#: Address bits of the table that says at once that a q-gram is none of the block's.
MEMBER_BITS = 22


def folded(text: str) -> np.ndarray:
    """Code points with ASCII capitals lowered and white space as blanks; positions stay."""
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint32)
    chars[(chars >= 65) & (chars <= 90)] += 32
    chars[(chars >= 9) & (chars <= 13)] = 32
    return chars


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    wide, out = chars.astype(np.uint64), np.zeros(len(chars) - q + 1, np.uint64)
    for k in range(q):
        out *= np.uint64(0x100000001B3)
        out += wide[k : len(chars) - q + 1 + k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out


def window_index(items: list[tuple[int, str]], q: int, window: int, step: int, edits: int) -> SimpleNamespace:
    """The windows of a block of items and the places of its q-grams.

    A q-gram is held once for each place in the items, not for each window there: which windows cover a place follows
    from where they begin and end. Windows are in the order of their places in ``text``, the items behind each other.
    """
    room = sum(len(text) for _, text in items)
    text, hashes, place, many = np.empty(room, np.uint32), np.empty(room, np.uint64), np.empty(room, np.int32), np.empty(room, np.int32)
    item, begin, width, chars, grams = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
    for number, own in items:
        whole = folded(own)
        if len(whole) <= q:  # no more than one q-gram
            continue
        wide = min(window, len(whole))
        starts = np.append(np.arange(0, len(whole) - wide, step), len(whole) - wide)
        over = _covering(SimpleNamespace(q=q, begin=starts, end=starts + wide), np.arange(len(whole) - q + 1))[1]
        inside = np.flatnonzero(over)
        to = slice(grams, grams := grams + len(inside))
        hashes[to], place[to], many[to] = gram_hashes(whole, q)[inside], inside + chars, over[inside]
        item += [number] * len(starts)
        begin.append(starts + chars)
        width.append(np.full(len(starts), wide))
        text[chars : (chars := chars + len(whole))] = whole
    begin, width = np.concatenate(begin), np.concatenate(width)
    # no more edits than leave one shared q-gram, or than the rate allows
    budget = np.maximum(0, np.minimum(edits * width // window, width // q - 1))
    index = SimpleNamespace(q=q, text=text[:chars], item=item, begin=begin, end=begin + width, width=width, budget=budget, need=width + 1 - q * (budget + 1))
    order = np.argsort(hashes[:grams], kind="stable")
    hashes, index.place, many = hashes[order], place[order], many[order]
    del order, place
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    index.unique = hashes[fresh]
    index.start = np.append(np.flatnonzero(fresh), len(hashes)).astype(np.int32)
    index.count = np.add.reduceat(many, index.start[:-1]) if len(many) else many  # windows over all places of a q-gram
    index.member = np.zeros(1 << MEMBER_BITS, bool)
    index.member[index.unique >> np.uint64(64 - MEMBER_BITS)] = True
    # for a large block the table above lets much pass: one more, a bit for a cell and 32 cells or more for a q-gram
    index.cell_bits = len(index.unique).bit_length() + 5
    index.cells = np.zeros((1 << index.cell_bits) // 8, np.uint8)
    byte, bit = _cell(index, index.unique)
    np.bitwise_or.at(index.cells, byte, bit)
    return index


def _cell(index: SimpleNamespace, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte and the bit in it of the hashes' cells, from the bits below those that ``member`` looks at."""
    cell = (hashes << np.uint64(MEMBER_BITS)) >> np.uint64(64 - index.cell_bits)
    return cell >> np.uint64(3), np.left_shift(np.uint8(1), (cell & np.uint64(7)).astype(np.uint8))


def _covering(index: SimpleNamespace, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first window over the q-gram at each place, and how many there are; they are numbered on from it."""
    first = np.searchsorted(index.end, place + index.q)
    return first, np.maximum(np.searchsorted(index.begin, place, side="right") - first, 0)


def _from_each(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``many`` numbers on from each ``first``, one run behind the other."""
    return np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _shared(index: SimpleNamespace, chars: np.ndarray):
    """Places in the text, ascending, that start a q-gram of the index, and the number of the q-gram."""
    hashes = gram_hashes(chars, index.q)
    places = np.flatnonzero(index.member[hashes >> np.uint64(64 - MEMBER_BITS)])
    byte, bit = _cell(index, hashes[places])
    places = places[index.cells[byte] & bit != 0]
    found = hashes[places]
    at = np.minimum(np.searchsorted(index.unique, found), max(len(index.unique) - 1, 0))
    true = index.unique[at] == found
    return places[true], at[true]


def _full_bands(index: SimpleNamespace, places: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(window, band) of the bands that the shared q-grams at some places fill to the lemma's count, each once."""
    repeats = index.start[at + 1].astype(np.int64) - index.start[at]
    place = index.place[_from_each(index.start[at], repeats)]
    first, many = _covering(index, place)
    each = np.repeat(np.repeat(np.arange(len(places)), repeats), many)
    window = _from_each(first, many)
    offset = np.repeat(place, many) - index.begin[window]
    band = (places[each] - offset) // (index.budget[window] + 1)
    # each hit lies in the band that starts in its stride and in the one that starts a stride before
    low, wide = band.min() - 1, int(index.width.max())
    many = int(band.max() - low) + 1
    key = (window * many + (band - low)) * wide + offset
    key = np.unique(np.concatenate([key, key - wide])) // wide
    cell, filled = np.unique(key, return_counts=True)
    cell = cell[filled >= index.need[cell // many]]
    return np.stack([cell // many, cell % many + low])


def _bands(index: SimpleNamespace, chars: np.ndarray):
    """(window, first diagonal) of the bands of 2 (k + 1) diagonals that meet the lemma's count.

    Places are taken in runs of bounded numbers of hits, each with as much text behind it as a band can reach, so a
    q-gram that repeats in the text and in an item takes time but no more memory.
    """
    places, at = _shared(index, chars)
    if not len(places):
        return places, places
    reach = int(index.width.max()) + 2 * (int(index.budget.max()) + 1)
    upto = np.cumsum(index.count[at])
    found, first = [], 0
    while first < len(places):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + HITS)))
        end = np.searchsorted(places, places[last - 1] + reach, side="right")
        found.append(_full_bands(index, places[first:end], at[first:end]))
        first = last
    window, band = np.unique(np.concatenate(found, axis=1), axis=1)
    return window, band * (index.budget[window] + 1)


def banded_edits(pattern: np.ndarray, region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits to fit each row of ``pattern`` (n, w) into its ``region`` (n, w + b - 1), free at both ends.

    Cell (i, d) aligns i characters of the pattern up to diagonal d of the band. Zeros in a region are walls.
    Returns the edits and the place in the region where the best fit ends.
    """
    n, w = pattern.shape
    b = region.shape[1] - w + 1
    cost = np.where(region == 0, WALL, 1)
    row = np.zeros((n, b), np.int64)
    for i in range(w):
        here, step = region[:, i : i + b], cost[:, i : i + b]
        now = row + np.where(here == pattern[:, i : i + 1], 0, step)
        now[:, :-1] = np.minimum(now[:, :-1], row[:, 1:] + 1)
        run = np.cumsum(step, axis=1)
        row = np.minimum.accumulate(now - run, axis=1) + run
    best = row.argmin(axis=1)
    return row[np.arange(n), best], best + w


def search(index: SimpleNamespace, texts: list[str]) -> list[tuple[int, int, int, int]]:
    """(text number, window, end, edits) of the windows found in some texts, end in code points."""
    # texts are set apart by a wall, which no q-gram of the index contains and no alignment crosses
    parts = [folded(t) for t in texts]
    wall = np.zeros(1, np.uint32)
    chars = np.concatenate([x for p in parts for x in (p, wall)])
    begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    windows, diagonals = _bands(index, chars)
    out = []
    for width, edits in {*zip(index.width[windows].tolist(), index.budget[windows].tolist())}:
        same = (index.width[windows] == width) & (index.budget[windows] == edits)
        chosen, start = windows[same], diagonals[same] - edits
        reach = np.arange(width + 2 * (edits + 1) + 2 * edits)[None, :]
        for at in range(0, len(chosen), 4096):
            inside = start[at : at + 4096, None] + reach
            region = np.where((inside >= 0) & (inside < len(chars)), chars[np.clip(inside, 0, len(chars) - 1)], 0)
            pattern = index.text[index.begin[chosen[at : at + 4096], None] + np.arange(width)]
            found, end = banded_edits(pattern, region)
            good = found <= edits
            ends = inside[:, 0][good] + end[good]
            text = np.searchsorted(begins, ends - 1, side="right") - 1
            out += zip(text.tolist(), chosen[at : at + 4096][good].tolist(), (ends - begins[text]).tolist(), found[good].tolist())
    return out


def _item_blocks(benchmark: DataFrame):
    """The items in blocks of bounded size, one block on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", text_of().alias("text")).toLocalIterator():
        if block and size + len(row["text"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, window: int = WINDOW, step: int = STEP, edits: int = EDITS) -> DataFrame:
    """One row for each document and item of which it holds a window: doc_id, text_hash, item_id, n_windows, first_end, last_end, edits.

    ``edits`` is the least of the windows found; the ends are code points of the text. A passage of
    ``window + step`` characters of an item, with no more than ``edits`` edits in a window, holds a whole window.
    Null and empty texts hold nothing; an item shorter than a window is looked for whole, with fewer edits, if it has
    more than ``q`` characters; rows with one doc_id and
    text are one document. Empty tables give an empty result; other columns are not read.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    out, blocks = None, _item_blocks(benchmark)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        index = keyed.sparkSession.sparkContext.broadcast(window_index(block, q, window, step, edits))

        def run(batches, index=index):
            for batch in batches:
                ids, hashes, texts = batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(), batch["text"].to_pylist()
                at = 0
                while at < len(texts):
                    end, size = at, 0
                    while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE_CHARS):
                        size += len(texts[end])
                        end += 1
                    found = search(index.value, texts[at:end])
                    columns = [[ids[at + f[0]] for f in found], [hashes[at + f[0]] for f in found], [index.value.item[f[1]] for f in found], [f[1] for f in found], [f[2] for f in found], [f[3] for f in found]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "text_hash", "item_id", "part", "end", "edits"])
                    at = end

        hits = keyed.mapInArrow(run, "doc_id long, text_hash long, item_id long, part long, end long, edits long")
        if out is not None or following is not None:  # else all indexes would be held until the passes run
            hits = stored(hits, "block-hits")
            index.destroy()
        out, block = hits if out is None else out.unionByName(hits), following
    return out.groupBy("doc_id", "text_hash", "item_id").agg(
        F.countDistinct("part").alias("n_windows"), F.min("end").alias("first_end"), F.max("end").alias("last_end"), F.min("edits").alias("edits")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without those that hold a window of a benchmark item; columns stay."""
    bad = contaminated(docs, benchmark, **settings).select("doc_id", "text_hash").distinct()
    return boxed(docs).join(bad, same_document(), "left_anti").select("row.*")
