"""Sets of word shingles as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

_M = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _M + np.uint64(seed))


SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Each byte's number; A-Z count as a-z, white space as nothing.
_BYTE = np.where(SPACE, np.uint64(0), numbers(256, 7))
_BYTE[65:91] = _BYTE[97:123]


class _Powers:
    """Powers of the base and of its inverse modulo 2**64."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _INVERSE))
        return cls.up[:n], cls.down[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and the place of each text's first word, with the end."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    up, down = _Powers.of(len(data) + 1)
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:-1])])
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return h, np.searchsorted(starts, offsets)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in order, and where each text's begin, with the end.

    A text of fewer words than `size` has its whole sequence as one shingle; one without words has none.
    """
    h, first = word_hashes(texts)
    n = np.diff(first)
    rows = max(0, len(h) - size + 1)
    s = h[:rows].copy()
    for j in range(1, size):
        s = mix(s * _M + h[j : rows + j])
    doc = np.repeat(np.arange(len(texts)), n)
    inside = doc[:rows] == doc[size - 1 :] if rows else np.zeros(0, bool)
    values, owner = s[inside], doc[:rows][inside]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for k, d in enumerate(short):
            x = np.array([n[d]], np.uint64) + np.uint64(1 << 40)
            for w in h[first[d] : first[d + 1]]:
                x = mix(x * _M + w)
            whole[k] = x[0]
        at = np.searchsorted(owner, short)
        values, owner = np.insert(values, at, whole), np.insert(owner, at, short)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    if len(values):
        fresh = np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])])
        values, owner = values[fresh], owner[fresh]
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return values, bounds
