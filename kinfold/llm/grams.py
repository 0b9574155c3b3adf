"""Vectorised hashing of words, shingles and byte windows over Arrow batches.

All hashes are 64-bit polynomials modulo 2**64 in an odd base, finished by a bijective mixer.
Prefix sums give the hash of any byte range in one subtraction, so a batch costs a few passes
over its bytes whatever the lengths of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C55
_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers that make a shingle depend on the order of its words.
_PLACE = np.array([pow(0xD6E8FEB86659FD93, j + 1, 1 << 64) | 1 for j in range(64)], dtype=np.uint64)

CHUNK_BYTES = 4 << 20
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _M)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64. Tables up to a few chunks' length are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            more = min(done, size - done)
            have[done : done + more] = have[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


class Prefix:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _power(_INV, len(self.sums))[start]

    def every(self, width: int) -> np.ndarray:
        """Of all ranges of ``width`` bytes, in order."""
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * _power(_INV, n)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of a text column, of about ``most`` bytes or one row. Null: empty."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text with the total appended, starts, ends). A-Z count as a-z."""
    n = len(data)
    low = _LOWER[data]
    ink = ~_SPACE[low]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] |= ink[inner]
    last[inner - 1] |= ink[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return mix(Prefix(low).ranges(start, end)), np.searchsorted(start, off), start, end


def shingles(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, place of each text's first with the total appended), repeats included.

    A text with fewer words gives one shingle of all its words; one without words gives none.
    """
    w, at, _, _ = words(data, off)
    count = np.diff(at)
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    acc = np.zeros(n, np.uint64)
    for j in range(width):
        acc[: n - j] += w[j:] * _PLACE[j]
    keep = np.zeros(n, bool)
    lens = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    text_of = np.repeat(np.arange(len(count)), count)
    inside = np.arange(n) - at[text_of]
    keep = inside < lens[text_of]
    for t in np.flatnonzero((count > 0) & (count < width)):
        own = w[at[t] : at[t + 1]]
        acc[at[t]] = (own * _PLACE[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(acc[keep], 1), np.concatenate([[0], np.cumsum(lens)])


def distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted, and the new places."""
    text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, text_of))
    h, t = hashes[order], text_of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], np.searchsorted(t[new], np.arange(len(at)))
