"""Runs of word bytes in chunks of UTF-8 texts, for any definition of a word by bytes, as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from almoneda.llm.textcore import _LOWER, U, mix64, powers


def runs(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, firsts) of the runs of bytes that is_word marks; a run never crosses texts. firsts: of each text's
    runs, and the end of the last text's."""
    word = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits for the bytes of each run with A-Z lowered, never 0; other seeds give other collisions."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = powers(len(data))
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    with np.errstate(over="ignore"):
        keyed = mix64((_LOWER[data].astype(U) + U(1)) + U(seed % 2**56) * U(256)) if seed else _LOWER[data].astype(U) + U(1)
        np.cumsum(keyed * up[: len(data)], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * down[starts]
        return np.maximum(mix64(raw + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)), U(1))


def texts_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """The bytes of each run with A-Z lowered, as an Arrow array."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(_LOWER[data[at]]))


def owners(firsts: np.ndarray) -> np.ndarray:
    """For each run the number of its text."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
