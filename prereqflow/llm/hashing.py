"""Vectorised hashes: words, runs of consecutive symbols, and the anchors that windows share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240117)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers = (np.ones(1, U), np.ones(1, U))
#: Symbols of one pass; longer documents are taken in overlapping parts.
BLOCK = 1 << 20
_BITS = 22
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all others."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, BLOCK + 1024)
        _powers = tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(m, b, U))]) for b in (_BASE, _INVERSE))
    return _powers[0][:n], _powers[1][:n]


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive values."""
    if len(values) < k:
        return np.zeros(0, U)
    s = _sums(values)
    return mix((s[k:] - s[:-k]) * powers(len(values) - k + 1)[1])


def words(buf: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the bytes of a text: where its words begin and end, and their hashes."""
    space = np.concatenate([[True], _IS_SPACE[buf], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    s = _sums(_BYTES[_LOWER[buf] if lower else buf])
    h = mix((s[end] - s[start]) * powers(len(buf) + 1)[1][start] + (end - start).astype(U))
    return start, end, h


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTES[buf]


def sliding_min(c: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        c = np.minimum(c[:-span], c[span:])
        span *= 2
    return np.minimum(c[: -(width - span)], c[width - span :]) if span < width else c


def anchors(documents: list[np.ndarray], window: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each document a list of symbol values: document, anchor, first window, last window, hash of the k symbols at the anchor.

    The anchor of a window is the leftmost of its least k-symbol runs by hash, so equal windows have it at the same place,
    wherever they stand. Consecutive windows mostly share one: each row stands for the windows that start from first to last.
    """
    batch: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for i, values in enumerate(documents):
        for at in range(0, max(0, len(values) - window + 1), BLOCK):
            part = values[at : at + BLOCK + window - 1]
            if batch and size + len(part) > BLOCK:
                yield _anchors(batch, window, k)
                batch, size = [], 0
            batch.append((i, at, part))
            size += len(part)
    if batch:
        yield _anchors(batch, window, k)


def _anchors(batch: list[tuple[int, int, np.ndarray]], window: int, k: int) -> tuple[np.ndarray, ...]:
    lengths = np.array([len(v) for _, _, v in batch])
    ends = np.cumsum(lengths)
    begins = ends - lengths
    h = rolling(np.concatenate([v for _, _, v in batch]) if len(batch) > 1 else batch[0][2], k)
    place = np.arange(len(h), dtype=U)
    least = sliding_min((h & ~U((1 << _BITS) - 1)) | place, window - k + 1)
    valid = np.ones(len(least), bool)
    for e in ends[:-1]:
        valid[e - window + 1 : e] = False
    starts = np.flatnonzero(valid)
    anchor = (least[starts] & U((1 << _BITS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, last, anchor = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1], anchor[new]
    part = np.searchsorted(ends, first, side="right")
    shift = np.array([at for _, at, _ in batch])[part] - begins[part]
    return np.array([i for i, _, _ in batch])[part], anchor + shift, first + shift, last + shift, h[anchor]
