"""Word splitting and hashing of whole Arrow text columns with numpy, without a Python loop per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. A null text has no words.
Texts are taken in slices of about `limit` bytes, so that the temporaries stay small; a text longer than
that is a slice of its own and is still handled whole.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
PLAIN = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: As PLAIN, with A-Z hashed like a-z.
FOLDED = PLAIN.copy()
FOLDED[65:91] = PLAIN[97:123]
_powers = {b: np.ones(1, dtype=np.uint64) for b in (_BASE, _UNBASE)}


class Words(NamedTuple):
    """starts, ends: byte places; first: where each text's words begin (one more than texts); hashes: uint64."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = 1 << 21, rows: int = 1 << 20):
    """Yields (first row, last row + 1, bytes, offsets into these bytes) over a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = PLAIN) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, np.zeros(len(offsets), dtype=np.int64), np.zeros(0, dtype=np.uint64))
    solid = ~_SPACE[data]
    left, right = solid.copy(), solid.copy()
    left[1:] &= ~solid[:-1]
    right[:-1] &= ~solid[1:]
    at = offsets[:-1]
    at = at[at < n]
    left[at] = solid[at]
    at = offsets[1:]
    at = at[at > 0] - 1
    right[at] = solid[at]
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(table[data] * _power(_BASE, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power(_UNBASE, n)[starts])
    return Words(starts, ends, np.searchsorted(starts, offsets), hashes)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, also of those that cross texts (see `inside`)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(out)


def inside(w: Words, k: int) -> np.ndarray:
    """Which of `grams` lie within one text."""
    n = max(0, len(w.hashes) - k + 1)
    ok = np.ones(n, dtype=bool)
    for j in range(1, k):  # a text that begins j words after the start cuts the window
        cut = w.first[1:-1] - j
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lines that hold a word: text_of, hashes (of all their bytes), byte lengths, last bytes. Only \\n ends a line."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none, none.astype(np.uint8)
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(breaks + 1, offsets[:-1])
    starts = starts[starts < n]
    text_of = np.searchsorted(offsets, starts, "right") - 1
    at = np.searchsorted(breaks, starts)
    ends = np.minimum(np.append(breaks, n)[at], offsets[text_of + 1])
    solid = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(~_SPACE[data], out=solid[1:])
    some = solid[ends] > solid[starts]
    starts, ends, text_of = starts[some], ends[some], text_of[some]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(PLAIN[data] * _power(_BASE, n), out=sums[1:])
    return text_of, mix((sums[ends] - sums[starts]) * _power(_UNBASE, n)[starts]), ends - starts, data[ends - 1]


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of byte flags within each text."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def again(keys: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(not the first of its key in its text, one of two or more), for keys in the order of the texts."""
    whole = mix(keys ^ (text_of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(whole, kind="stable")
    same = whole[order][1:] == whole[order][:-1]
    later, shared = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:]] = same
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    return later, shared


def repeated_words(w: Words, k: int) -> np.ndarray:
    """For each text the number of words in k-word windows that are found twice or more in it."""
    ok = inside(w, k)
    at = np.flatnonzero(ok)
    texts = w.text_of
    _, shared = again(grams(w.hashes, k)[at], texts[at]) if len(at) else (None, np.zeros(0, dtype=bool))
    cover = np.zeros(len(w.hashes) + 1, dtype=np.int64)
    np.add.at(cover, at[shared], 1)
    np.add.at(cover, at[shared] + k, -1)
    return per_text(np.cumsum(cover[:-1]) > 0, w.first)
