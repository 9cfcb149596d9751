"""Word-level kernels over Arrow string columns.

Everything here works on the raw UTF-8 buffers of a column, so that no Python
string is made per row: words are runs of bytes other than the six ASCII white
space characters, and a word's hash is a difference of prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass of the kernels holds; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 18

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _random.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0..n-1, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        # what a usual pass needs is kept, what a long text needs is not
        have = np.full(max(n, CHUNK_BYTES + 1024), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= CHUNK_BYTES + 1024:
            _powers[base] = have
    return have[:n]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values in each of the ranges that consecutive bounds delimit."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of some texts: raw bytes, their lower-case form, starts and ends, and each text's range of words."""

    raw: np.ndarray
    low: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self, exact: bool = False) -> np.ndarray:
        """64-bit hashes of the words with A-Z in lower case, or of their exact bytes."""
        n = len(self.low)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        coded = BYTE_CODE[self.raw if exact else self.low] * powers(_BASE, n)
        total = np.cumsum(coded, dtype=np.uint64)
        return mix((total[self.ends - 1] - total[self.starts] + coded[self.starts]) * powers(_INVERSE, n)[self.starts])

    def rows(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    white = WHITE[raw]
    first = ~white
    last = first.copy()
    first[1:] &= white[:-1]
    last[:-1] &= white[1:]
    full = offsets[1:] > offsets[:-1]
    begin, end = offsets[:-1][full], offsets[1:][full] - 1
    first[begin] = ~white[begin]
    last[end] = ~white[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(raw, LOWER[raw], offsets, starts, ends, np.searchsorted(starts, offsets))


def each(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """The words of a column's texts, a bounded number of bytes at a time, with the range of rows."""
    raw, offsets = buffers(column)
    for i, j in pieces(offsets, limit):
        at = offsets[i : j + 1]
        yield i, j, words(raw[at[0] : at[-1]], at - at[0])


def grams(hashes: np.ndarray, n: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hashes of every n consecutive words; item i starts at word i. Ranges that leave a text are the caller's to skip."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out += hashes[j : len(hashes) - n + 1 + j] * np.uint64(pow(seed, j + 1, 2**64))
    return mix(out)


def gear(codes: np.ndarray, n: int) -> np.ndarray:
    """Rolling gear hash over words: the hash so far, shifted by 64 / n bits, plus the word's code, so that n words count.

    Item i is the hash of the n words from i on. Its upper bits depend on all of
    them; ranges that leave a text are the caller's to skip.
    """
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for j in range(n):
        out = (out << np.uint64(64 // n)) + codes[j : len(codes) - n + 1 + j]
    return out


def lists(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    """A list column out of bounds and flat values."""
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(values)).cast(pa.list_(pa.array(values[:0]).type))
