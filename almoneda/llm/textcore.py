"""Vectorised reading of UTF-8 texts: words, their hashes, and sets of shingles, as numpy arrays over Arrow buffers.

Nothing here makes a Python object per word. Texts are taken whole; batches are cut into chunks of about a megabyte (or
one longer text), which bounds memory by the chunk and not by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 20
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PAIRS = (0xC6A4A7935BD1E995, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9, 0xF1357AEA2E62A9C5)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0..n-1 and -0..-(n-1), modulo 2^64."""
    if len(_powers[0]) < n:
        n = max(n, CHUNK + 1024)
        for i, b in enumerate((_BASE, _INVERSE)):
            x = np.full(n, b, U)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `most` bytes. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, len(column))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a chunk: byte ranges, and per text the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        word = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edge[1:-1]
        ends[:-1] &= ~word[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.firsts = np.searchsorted(self.starts, offsets)  # of each text's words, and the end of the last one's

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """64 bits for each word's bytes, letters A-Z lowered first if so asked."""
        if not len(self.starts):
            return np.zeros(0, U)
        up, down = powers(len(self.data))
        sums = np.empty(len(self.data) + 1, U)
        sums[0] = 0
        data = _LOWER[self.data] if lower else self.data
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix64(raw + (self.ends - self.starts).astype(U) * U(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64 bits for each run of `size` consecutive hashes; run i starts at i."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    for j in range(size):
        total = total * U(0xC6A4A7935BD1E995) + hashes[j : j + n]
    return mix64(total)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles of `size` words; the whole sequence as one if there are fewer words."""
    words = Words(data, offsets)
    hashes = words.hashes()
    runs = window_hashes(hashes, size)
    for a, b in zip(words.firsts[:-1].tolist(), words.firsts[1:].tolist()):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            yield mix64(window_hashes(hashes[a:b], b - a) + U(b - a))
        else:
            yield np.zeros(0, U)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """A number for each code point of UTF-8 bytes (its bytes, the first one lowest), and where they begin; None: everywhere."""
    if not len(data) or data.max() < 128:
        return data, None
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[begins].astype(np.uint32)
    wide = np.flatnonzero(points >= 0xC0)
    at = begins[wide]
    for k in (8, 16, 24):
        at = at + 1
        more = (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80) & (at < len(data))
        wide, at = wide[more], at[more]
        points[wide] |= data[at].astype(np.uint32) << np.uint32(k)
    return points, begins


def point_runs(points: np.ndarray, size: int) -> np.ndarray:
    """64 bits for each run of `size` code points; run i starts at code point i."""
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    run, long = points.astype(U), 1
    run += U(1)
    while 2 * long <= size:  # two runs make one of twice their length
        twice = run[:-long] * U(_PAIRS[long.bit_length() % len(_PAIRS)])
        twice += run[long:]
        run, long = twice, 2 * long
    if long < size:  # the last runs overlap
        run = run[:n] * U(_PAIRS[0]) + run[size - long :]
    run += U(size * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    return mix64(run)


def char_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct runs of `size` code points; the whole text as one if it is shorter."""
    points, begins = code_points(data)
    firsts = (offsets if begins is None else np.searchsorted(begins, offsets)).tolist()
    runs = point_runs(points, size)
    for a, b in zip(firsts[:-1], firsts[1:]):
        if b - a >= size:
            runs[a : b - size + 1].sort()
    fresh = np.ones(len(runs), bool)
    np.not_equal(runs[1:], runs[:-1], out=fresh[1:])
    for a, b in zip(firsts[:-1], firsts[1:]):
        if b - a >= size:
            fresh[a] = True
            yield runs[a : b - size + 1][fresh[a : b - size + 1]]
        elif b > a:
            yield point_runs(points[a:b], b - a)
        else:
            yield np.zeros(0, U)


def set_key(s: np.ndarray) -> bytes:
    """128 bits that name a set of 64-bit values: two sums of unlike bijections of its members."""
    with np.errstate(over="ignore"):
        a = mix64(s + U(0x9E3779B97F4A7C15)).sum(dtype=U)
        b = mix64(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U)
    return (int(a) << 64 | int(b)).to_bytes(16, "big")
