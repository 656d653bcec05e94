"""Vectorised tokens of a column of texts, straight from Arrow's UTF-8 buffers.

Words are maximal runs of ASCII letters, digits and bytes of non-ASCII
characters; every other byte separates. A word's hash is a polynomial in its
bytes modulo 2**64, taken from running sums, so that no Python object is made
per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time: the working arrays are some 40 times that.
SLICE = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)

WORD_BYTE = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD_BYTE[_lo:_hi] = True

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)

#: Words between ASCII white space, and bytes that differ by case.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
EXACT = np.arange(1, 257, dtype=np.uint64)

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to ``n`` of them."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (a multiply-xorshift finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the ``n + 1`` offsets of its rows (a null row is empty)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - (at[0] if len(at) else 0)


def _slices(data: np.ndarray, cuts: np.ndarray, word_byte: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of about SLICE bytes that no word straddles; one word longer than that stays whole."""
    out, lo, n = [], 0, len(data)
    while lo < n:
        hi = min(n, lo + SLICE)
        while hi < n:
            gap = np.flatnonzero(~word_byte[data[hi : hi + SLICE]])
            edge = cuts[np.searchsorted(cuts, hi) : np.searchsorted(cuts, hi) + 1]
            stop = min([hi + int(gap[0])] * bool(len(gap)) + [int(e) for e in edge] + [n + 1])
            if stop <= n:
                hi = stop
                break
            hi = min(n, hi + SLICE)
        out.append((lo, hi))
        lo = hi
    return out


def words(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray = WORD_BYTE, values: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end byte of every word of the concatenated texts, in order. ``word_byte`` says which bytes make words, ``values`` what each counts."""
    hashes, starts, ends = [], [], []
    for lo, hi in _slices(data, offsets, word_byte):
        part = data[lo:hi]
        inside = word_byte[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = offsets[(offsets > lo) & (offsets < hi)] - lo
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _power_table(len(part) + 1)
        run = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(values[part] * up[: len(part)], out=run[1:], dtype=np.uint64)
        hashes.append(mix64((run[e] - run[s]) * down[s]))
        starts.append(s + lo)
        ends.append(e + lo)
    if not hashes:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    start = np.concatenate(starts)
    row = np.searchsorted(offsets, start, side="right") - 1
    return np.concatenate(hashes), row, start, np.concatenate(ends)


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 48-bit hash of every run of ``width`` words; a shorter text is one shingle of all its words."""
    count = np.bincount(row, minlength=rows)
    odd = mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(hashes)
    total = np.zeros(max(n, 0), dtype=np.uint64)
    fits = count[row] >= width if n else np.zeros(0, bool)
    begin = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(count, out=begin[1:])
    at = np.arange(n) - begin[row] if n else np.zeros(0, np.int64)
    for k in range(width):
        total[: n - k] += hashes[k:] * odd[k]
    whole = fits & (at + width <= count[row]) if n else fits
    out_row, out = [row[whole]], [total[whole]]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        picked = np.flatnonzero(~fits)
        terms = hashes[picked] * odd[at[picked]]
        sums = np.zeros(rows, dtype=np.uint64)
        np.add.at(sums, row[picked], terms)
        out_row.append(short)
        out.append(sums[short] + mix64(count[short].astype(np.uint64)))
    return np.concatenate(out_row), mix64(np.concatenate(out)) >> np.uint64(16)


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and occurrences of each distinct shingle, sorted by row; needs fewer than 2**16 rows."""
    rows = len(offsets) - 1
    hashes, row, _, _ = words(data, offsets)
    of, sh = shingles(hashes, row, rows, width)
    key = np.sort((of.astype(np.uint64) << np.uint64(48)) | sh)
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count
