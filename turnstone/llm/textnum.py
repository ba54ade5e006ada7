"""Whole texts as numpy arrays: words, word hashes, n-grams and sliding minima over Arrow string columns.

Texts are taken piece by piece, whole documents up to about PIECE bytes, so memory is bounded by the longest
document and not by the batch. Hashes are polynomials modulo 2**64, finished by a bijective mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, 2 * PIECE + 1)
        _powers[:] = []
        for x in (_STEP, _BACK):
            p = np.full(m, x, U)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers[0][:n], _powers[1][:n]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the documents in them); a null text is empty."""
    a = batch.column(batch.schema.get_field_index(column))
    a = pc.fill_null(a, "") if a.null_count else a
    kind = np.int64 if pa.types.is_large_string(a.type) else np.int32
    _, at, data = a.buffers()
    n = len(a)
    off = np.frombuffer(at, kind)[a.offset : a.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document (and one past the last) the number of its first word."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = _SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    edge[1:-1] |= space[:-1] != space[1:]
    at = np.flatnonzero(edge)
    inside = ~space[at[:-1]]
    start, stop = at[:-1][inside], at[1:][inside]
    return start, stop, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of the words (in order) from ``start`` to ``stop``; long texts are taken in sections, which may cut words."""
    value = _LOWER if lower else _BYTE
    total = np.zeros(len(start), U)
    for a in range(0, len(buf), 2 * PIECE):
        b = min(len(buf), a + 2 * PIECE)
        up, back = powers(b - a + 1)
        sums = np.zeros(b - a + 1, U)
        np.cumsum(value[buf[a:b]] * up[:-1], out=sums[1:])
        i, j = np.searchsorted(stop, a, "right"), np.searchsorted(start, b)
        lo = np.maximum(start[i:j] - a, 0)
        part = (sums[np.minimum(stop[i:j], b) - a] - sums[lo]) * back[lo]
        if i < j and start[i] < a:  # a word that began in an earlier section
            part[0] *= U(pow(_STEP, a - int(start[i]), 2**64))
        total[i:j] += part
    return mix(total + (stop - start).astype(U) * U(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of h[i : i + k] for every i; runs across documents are the caller's to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * U(_STEP) + h[j : n + j]
    return mix(out)


def within(first: np.ndarray, k: int) -> np.ndarray:
    """For documents that begin at ``first`` (one past the last included): starts of k symbols in one document."""
    n = np.diff(first)
    m = np.maximum(n - k + 1, 0)
    total = int(m.sum())
    return np.arange(total) + np.repeat(first[:-1] - np.r_[0, np.cumsum(m)[:-1]], m) if total else np.zeros(0, np.int64)


def sliding(h: np.ndarray, w: int, least: bool = True) -> np.ndarray:
    """Minimum (or maximum) of h[i : i + w] for every i."""
    f, out, have = (np.minimum if least else np.maximum), h, 1
    while have < w:
        step = min(have, w - have)
        if len(out) <= step:
            return out[:0]
        out = f(out[: len(out) - step], out[step:])
        have += step
    return out


def packed(x: np.ndarray) -> bytes:
    """Numbers by their first, second, ... bytes, compressed: most have few bytes that are not 0."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def unpacked(data: bytes | None, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
