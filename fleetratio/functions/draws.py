"""Random numbers of the bootstrap for whole arrays of draws, inside tasks.

A draw is a number of a hash of (seed, stratum, node, replicate, hash number). ``md5`` hashes the text of the five
joined by ``|``, as plain SQL can; ``xxhash64`` hashes them as ``xxhash64(seed, stratum, node, replicate, number)``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from math import sin

import numpy as np
from pyspark import cloudpickle

# Draws that one hash of a sampler serves.
DRAWS_PER_HASH = {"xxhash64": 2, "md5": 4}
# Hashes computed at a time.
SLICE = 32_768

_U32, _U64 = np.uint32, np.uint64
_SHIFTS = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_SINES = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_P1, _P2, _P3, _P4, _P5 = (
    _U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _md5_block(state: Sequence, words: Sequence, count: int) -> list[np.ndarray]:
    """The state after one block; a word is one number for all messages or an array with one for each."""
    a, b, c, d = (np.array(np.broadcast_to(_U32(s) if np.ndim(s) == 0 else s, count)) for s in state)
    before = [a.copy(), b.copy(), c.copy(), d.copy()]
    f, t = np.empty(count, _U32), np.empty(count, _U32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        if isinstance(words[g], np.ndarray):
            np.add(a, words[g], out=a)
            np.add(a, _U32(_SINES[i]), out=a)
        else:
            np.add(a, _U32((words[g] + _SINES[i]) & 0xFFFFFFFF), out=a)
        np.left_shift(a, _U32(_SHIFTS[i]), out=t)
        np.right_shift(a, _U32(32 - _SHIFTS[i]), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return [x + y for x, y in zip((a, b, c, d), before)]


def _md5_alike(prefix: bytes, columns: Sequence[np.ndarray], widths: Sequence[int]) -> list[np.ndarray]:
    """md5 of ``prefix`` and the columns' decimals joined by ``|``, each column of one width: four numbers a message."""
    count = len(columns[0])
    size = len(prefix) + sum(widths) + len(widths) - 1
    text = bytearray(prefix + b"|".join(b"0" * w for w in widths) + b"\x80")
    text += bytes(-(len(text) + 8) % 64) + (8 * size).to_bytes(8, "little")
    words = [int.from_bytes(text[i : i + 4], "little") for i in range(0, len(text), 4)]
    end = len(prefix)
    for column, width in zip(columns, widths):
        end += width
        rest = column.astype(_U32 if width < 10 else _U64)
        for place in range(end - 1, end - 1 - width, -1):
            tens = rest // rest.dtype.type(10)
            digit = (rest - tens * rest.dtype.type(10)).astype(_U32)
            word = words[place // 4]
            words[place // 4] = (word if isinstance(word, np.ndarray) else _U32(word)) + (digit << _U32(8 * (place % 4)))
            rest = tens
        end += 1
    state: Sequence = _START
    for at in range(0, len(words), 16):
        state = _md5_block(state, words[at : at + 16], count)
    return [s.byteswap() for s in state]


def _widths(column: np.ndarray) -> np.ndarray:
    return np.searchsorted(10 ** np.arange(1, 19, dtype=np.int64), column, side="right") + 1


def md5_numbers(start: str, columns: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The four numbers of md5(``start`` and the columns, not negative, joined by ``|``)."""
    widths = [_widths(c) for c in columns]
    prefix = start.encode()
    if all(w.min() == w.max() for w in widths):
        return _md5_alike(prefix, columns, [int(w[0]) for w in widths])
    kind = sum(w * 32**i for i, w in enumerate(widths))
    out = [np.empty(len(kind), _U32) for _ in range(4)]
    for one in np.unique(kind):
        at = np.flatnonzero(kind == one)
        for numbers, found in zip(out, _md5_alike(prefix, [c[at] for c in columns], [int(w[at[0]]) for w in widths])):
            numbers[at] = found
    return out


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U64(by)) | (x >> _U64(64 - by))


def xxhash_numbers(start: int, columns: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Upper and lower half of xxhash64 of the columns, one after the other, begun with the hash ``start``."""
    h = np.full(len(columns[0]), start, np.int64).view(_U64)
    for column in columns:
        h = (h + _P5 + _U64(8)) ^ (_rotated(np.asarray(column, np.int64).view(_U64) * _P2, 31) * _P1)
        h = _rotated(h, 27) * _P1 + _P4
        h = (h ^ (h >> _U64(33))) * _P2
        h = (h ^ (h >> _U64(29))) * _P3
        h = h ^ (h >> _U64(32))
    return [(h >> _U64(32)).astype(_U32), h.astype(_U32)]


def numbers_drawn(
    sampler: str, start: str | int, columns: Sequence[np.ndarray], draws: np.ndarray, first: int = 0
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, random number) of the draws ``first`` .. ``first + draws - 1`` of each row, in the rows' order.

    A row is what the columns hold at one place; ``first`` begins a hash. Some thousands of hashes are held at a time.
    """
    each = DRAWS_PER_HASH[sampler]
    digest = md5_numbers if sampler == "md5" else xxhash_numbers
    ends = np.cumsum(-(-draws // each))
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, SLICE):
        high = min(low + SLICE, total)
        one, last = np.searchsorted(ends, [low, high - 1], side="right")
        begins = np.concatenate(([0], ends))[one : last + 1] if one == 0 else ends[one - 1 : last]
        row = np.repeat(np.arange(one, last + 1), np.minimum(ends[one : last + 1], high) - np.maximum(begins, low))
        number = np.arange(low, high) - begins[row - one]
        left = draws[row] - number * each
        partial = int(left.min()) < each
        for place, drawn in enumerate(digest(start, [*[c[row] for c in columns], number + first // each])):
            if partial and place:
                kept = left > place
                yield row[kept], drawn[kept]
            else:
                yield row, drawn


def count_draws(
    sampler: str, start: str | int, columns: Sequence[np.ndarray], draws: np.ndarray, sizes: np.ndarray, base: np.ndarray,
    cells: int, first: int = 0, group: int = 1,
) -> np.ndarray:
    """How often each cell is drawn: row r draws ``base[r]`` and one of the ``sizes[r]`` places after it, ``group`` places a cell.

    ``base`` rises with r. Cells below 0 or from ``cells`` on belong to others and are left out.
    """
    counts = np.zeros(cells, np.int32)
    size = _U32(sizes[0]) if len(sizes) and (sizes == sizes[0]).all() else None
    for row, number in numbers_drawn(sampler, start, columns, draws, first):
        if not len(row):
            continue
        by = size if size is not None else sizes[row].astype(_U32)
        cell = number - number // by * by
        if group > 1:
            cell = cell // _U32(min(group, 2**32 - 1))
        cell = base[row] + cell
        low, high = int(cell.min()), int(cell.max()) + 1
        if low < 0 or high > cells:
            cell = cell[(cell >= 0) & (cell < cells)]
            if not len(cell):
                continue
            low, high = int(cell.min()), int(cell.max()) + 1
        counts[low:high] += np.bincount(cell - low, minlength=high - low).astype(np.int32)
    return counts


# Functions that run in tasks travel with them, so executors need not have the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
