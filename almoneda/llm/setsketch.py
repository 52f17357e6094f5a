"""SetSketch: registers of exponentially spaced truncated minima (Ertl, VLDB 2021).

Register i of a set is floor(1 - log_b min_d x_i(d)), cut to 0..q+1, where x_i(d) is exponential with rate a. The
registers of a union are the maxima of the registers, so sketches merge; and two sets agree in a register at least as
often as their Jaccard similarity says, so runs of registers serve as bands. Here x_i(d) = -ln(1 - u_i(d)) / a, with u_i
from a hash; as x and the register are monotone in u, each register needs only the least u.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from almoneda.llm.textcore import U, mix64


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) int64 keys of (n, bands * rows) values; the low 6 bits are the band, so at most 64 bands."""
    r = values.reshape(len(values), bands, rows).astype(U)
    key = np.zeros((len(values), bands), U) + np.arange(bands, dtype=U)
    for j in range(rows):
        key = key * U(0xC6A4A7935BD1E995) + r[:, :, j] + U(1)
    return ((mix64(key) & ~U(63)) | np.arange(bands, dtype=U)).view(np.int64)


@dataclass(frozen=True)
class SetSketch:
    """m = bands * rows registers of 16 bits. b near 1 makes register equality nearly as rare as equal minima."""

    bands: int = 32
    rows: int = 6
    b: float = 1.001
    a: float = 20.0
    q: int = 65_534
    seed: int = 1
    _mul: np.ndarray = field(init=False, repr=False, compare=False)
    _add: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        raw = mix64(np.arange(2 * self.m, dtype=U) + U(self.seed) * U(0x632BE59BD9B4E019))
        object.__setattr__(self, "_mul", (raw[: self.m] >> U(32)).astype(np.uint32) | np.uint32(1))
        object.__setattr__(self, "_add", (raw[self.m :] >> U(32)).astype(np.uint32))

    @property
    def m(self) -> int:
        return self.bands * self.rows

    def registers(self, members: np.ndarray) -> np.ndarray:
        """uint16 registers of a set of 64-bit hashes; an empty set has zeros."""
        if not len(members):
            return np.zeros(self.m, np.uint16)
        h = (members >> U(32)).astype(np.uint32)
        least = np.full(self.m, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(h), 1024):  # blocks that stay in cache
            part = h[None, i : i + 1024] * self._mul[:, None]
            part += self._add[:, None]
            np.minimum(least, part.min(axis=1), out=least)
        x = -np.log1p(-(least + 0.5) / 4294967296.0) / self.a
        return np.clip(np.floor(1.0 - np.log(x) / np.log(self.b)), 0, self.q + 1).astype(np.uint16)

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Registers of the union of two sets."""
        return np.maximum(a, b)

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        """(n, bands) int64 keys of (n, m) registers; the low 6 bits are the band."""
        return band_keys(registers, self.bands, self.rows)

    def _log_likelihood(self, j, n_u, n_v, more, less, same):
        """Of similarity j, from the counts of registers that are larger in u, larger in v, and equal."""
        total = n_u + n_v
        u, v = n_u / total, n_v / total
        part = lambda x: -np.log1p(-np.clip(x, 0, 1) * (self.b - 1) / self.b) / np.log(self.b)
        p_more, p_less = part(u - v * j), part(v - u * j)
        p_same = np.maximum(1 - p_more - p_less, 1e-12)
        return more * np.log(np.maximum(p_more, 1e-12)) + less * np.log(np.maximum(p_less, 1e-12)) + same * np.log(p_same)

    def plausible(self, ru: np.ndarray, rv: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, at_least: float, odds: float = 12.0) -> np.ndarray:
        """Whether a similarity of at_least or more can't be ruled out: its joint likelihood is within e^odds of the best.

        At odds 12 a true pair is ruled out about once in a million.
        """
        n_u, n_v = np.asarray(n_u, float), np.asarray(n_v, float)
        more, less = (ru > rv).sum(-1), (ru < rv).sum(-1)
        same = self.m - more - less
        most = np.minimum(n_u / n_v, n_v / n_u)  # of any two sets of these sizes
        grid = np.linspace(0.0, 1.0, 41)[:, None] * np.minimum(most, at_least)[None]
        best = self._log_likelihood(grid, n_u, n_v, more, less, same).max(0)
        here = self._log_likelihood(np.minimum(at_least, most), n_u, n_v, more, less, same)
        return (most >= at_least - 1e-12) & ((here >= best - odds) | (same >= at_least * self.m))
