"""Vectorised text kernels over the bytes of Arrow string columns: word bounds and 64-bit word hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes handled at once; temporaries take some 60 times this. One longer text makes a block of its own.
BLOCK = 1 << 20

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {"pow": np.ones(1, U), "inv": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection of 64-bit integers without visible structure."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["pow"]) < n:
        n = max(n, BLOCK + 4096)
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            out = np.full(n, base, U)
            out[0] = 1
            _POWERS[name] = np.cumprod(out, dtype=U)
    return _POWERS["pow"][:n], _POWERS["inv"][:n]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string or binary array or chunked array; a null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def blocks(data: np.ndarray, offs: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bytes, offsets) of runs of texts of about ``size`` bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


#: Bytes of letters: ASCII letters and all bytes of other code points.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def word_bounds(data: np.ndarray, offs: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes in ``of``, else of what isn't white space), and for each text the index of its
    first word (n + 1)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = (~_SPACE if of is None else of)[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offs[:-1]
    before[inner[inner < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    last = offs[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with ``lower``, A-Z count as a-z."""
    n = len(data)
    if n == 0 or len(starts) == 0:
        return np.zeros(len(starts), U)
    pw, inv = _powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * pw[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(U))


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` lower-cased words; all words as one where there are fewer."""
    starts, ends, first = word_bounds(data, offs)
    h = word_hashes(data, starts, ends, True)
    out: list[np.ndarray] = []
    m = max(0, len(h) - width + 1)
    s = np.zeros(m, U)
    for k in range(width):
        s = (s + h[k : k + m]) * U(0xD6E8FEB86659FD93)
        s ^= s >> U(32)
    s = mix(s)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(s[a : b - width + 1])
            if len(x) > 1:
                x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            one = np.array([b - a], U)
            for k in range(a, b):
                one = mix(one * U(0xA0761D6478BD642F) + h[k : k + 1])
            x = one
        else:
            x = np.zeros(0, U)
        out.append(x)
    return out
