"""Distinct word shingles of many texts at once, as 63-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if len(_powers[0]) < n:
        size = max(n * 5 // 4, 1 << 20)
        for i, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes], endings: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of the words of all texts in order, A-Z lower-cased, and the number of words before each text (one more); with
    endings, also a number for the last two bytes of each word."""
    buf = b"\n".join(texts).lower() + b"\n"
    a = np.frombuffer(buf, np.uint8)
    space = _IS_SPACE[a]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    if not endings:
        return h, np.searchsorted(starts, begin)
    last = a[ends - 1].astype(np.uint64) * np.uint64(256) + np.where(ends - starts > 1, a[ends - 2], 0).astype(np.uint64)
    return h, np.searchsorted(starts, begin), last


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one, of all its words; of none, none."""
    h, at = word_hashes(texts)
    out = []
    if len(h) >= words:
        g = np.full(len(h) - words + 1, np.uint64(words), np.uint64)
        for i in range(words):
            g = g * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - words + 1 + i]
        g = mix(g) >> np.uint64(1)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= words:
            out.append(np.unique(g[lo : hi - words + 1]))
        elif hi > lo:
            v = np.full(1, hi - lo, np.uint64)
            for i in range(lo, hi):
                v = v * np.uint64(0xD6E8FEB86659FD93) + h[i : i + 1]
            out.append(mix(v) >> np.uint64(1))
        else:
            out.append(np.empty(0, np.uint64))
    return out
