"""SetSketch registers: exponentially spaced truncated minima of exponential hash values.

Each element starts a Poisson process of rate M; every point of it falls on a random register. So each register sees the first
point of a unit-rate process of every element, and its minimum over n elements is exponential with rate n, independent of the
other registers. A value x becomes floor(1 - log_b(x / A)), cut to [0, LIMIT]. Registers of a union are the larger of the two, and two sets'
registers are equal with about their Jaccard similarity as probability. Only points below a set's largest minimum matter, so a
set of n elements costs about n + M ln M points.
"""

from __future__ import annotations

import numpy as np

from .bytetext import U, mix

M = 256
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: By least similarity in percent: bands and registers of each. Two sets that agree in one whole band are compared; at the least similarity
#: all bands are missed with probability 5e-8 at 80, 2e-4 at 70 and 50, 3e-4 at 25.
BANDS = ((70, (32, 4)), (50, (64, 3)), (25, (128, 2)))
_GRID = np.linspace(0.0, 1.0, 101)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of M registers for each set of 64-bit element hashes; zeros for an empty set."""
    n = len(sets)
    lens = np.array([len(s) for s in sets], np.int64)
    low = np.full((n, M), np.inf)
    flat = low.reshape(-1)
    h = np.concatenate(sets) if n else np.zeros(0, U)
    row = np.repeat(np.arange(n), lens)
    x = np.zeros(len(h))
    step, burst = 0, 1
    while len(h):
        for _ in range(burst):
            step += 1
            r = mix(h + U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            x = x - np.log1p(-((r >> U(11)).astype(np.float64) * 2.0**-53)) / M
            np.minimum.at(flat, row * M + (r & U(M - 1)).astype(np.int64), x)
        alive = x < low.max(1)[row]
        h, row, x = h[alive], row[alive], x[alive]
        burst = 1 if len(h) > 20_000 else 8
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(low / RATE) / np.log(BASE))
    return np.clip(np.where(np.isinf(low), 0, k), 0, LIMIT + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def bands_for(percent: float) -> tuple[int, int]:
    """Bands and registers of each that find pairs of at least this similarity."""
    for least, shape in BANDS:
        if percent >= least:
            return shape
    raise ValueError(f"no banding finds pairs of {percent} percent; at least {BANDS[-1][0]} can be asked for")


def band_keys(regs: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A key of each band for each row."""
    bands, rows = shape
    r = regs[:, : bands * rows].astype(U).reshape(len(regs), bands, rows)
    key = np.arange(1, bands + 1, dtype=U)[None, :] * U(0x9E3779B97F4A7C15)
    key = np.repeat(key, len(regs), 0)
    for k in range(rows):
        key = mix(key * U(0xD6E8FEB86659FD93) + r[:, :, k] + U(1))
    return key.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log(np.clip(1 - x * (BASE - 1) / BASE, 1e-300, None)) / np.log(BASE)


def estimate(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray, at: float) -> tuple[np.ndarray, np.ndarray]:
    """Joint estimate from the counts of registers in which the first set's is more, or less: the Jaccard similarity of greatest
    likelihood, and by how much its log-likelihood exceeds the greatest of any similarity of at least ``at``."""
    na, nb = na.astype(float), nb.astype(float)
    u = na / (na + nb)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = np.minimum(_GRID[None, :], top[:, None])
    up, down = _p(np.clip(u[:, None] - v[:, None] * j, 0, None)), _p(np.clip(v[:, None] - u[:, None] * j, 0, None))
    same = np.clip(1 - up - down, 1e-12, None)
    ll = more[:, None] * np.log(np.clip(up, 1e-12, None)) + less[:, None] * np.log(np.clip(down, 1e-12, None)) + (M - more - less)[:, None] * np.log(same)
    best = ll.argmax(1)
    high = np.where(j >= at - 1e-9, ll, -np.inf).max(1)
    return j[np.arange(len(j)), best], ll.max(1) - high
