"""Word hashes and sets of 5-word shingles of whole texts, in numpy, a bounded block of texts at a time."""

from __future__ import annotations

import numpy as np

SIZE = 5
_U = np.uint64
_rng = np.random.default_rng(20240501)
#: A random number for each byte, the same for A-Z as for a-z; a word is a polynomial in these.
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_EXACT = _LETTER.copy()
_EXACT[ord("A") : ord("Z") + 1] = _rng.integers(1, 2**63, 26, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 2**63, SIZE, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """The first n powers of the base."""
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64), _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte, text number) of each word of a block; fold: A-Z count as a-z."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begins = np.zeros(len(texts), np.int64)
    begins[1:] = np.cumsum([len(t) + 1 for t in texts[:-1]]) if len(texts) > 1 else 0
    inside = ~_SPACE[buf]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    length = end - start
    first = np.zeros(len(start), np.int64)
    np.cumsum(length[:-1], out=first[1:])
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    value = (_LETTER if fold else _EXACT)[buf[inside]] * _power(int(length.max()))[place]
    hashed = mix(np.add.reduceat(value, first) + length.astype(np.uint64) * _BASE)
    of = np.searchsorted(begins, start, side="right") - 1
    return hashed, start - begins[of], end - begins[of], of


def windows(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive words, whatever text they belong to."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * _BASE + mix(hashed[j : j + n] + _U(j))
    return mix(total)


def sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block; fewer words than a shingle are one."""
    hashed, _, _, of = words(texts)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    n = len(hashed) - SIZE + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for j in range(SIZE):
        runs += hashed[j : j + max(n, 0)] * _PLACE[j]
    runs = mix(runs)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= SIZE:
            out.append(np.unique(runs[a : b - SIZE + 1]))
        elif b > a:
            out.append(mix((hashed[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _U(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> int:
    """One number for a set; equal sets have equal ones."""
    return int(mix(np.array([mix(tokens + _BASE).sum(dtype=np.uint64) + _U(len(tokens))], np.uint64)).view(np.int64)[0])
