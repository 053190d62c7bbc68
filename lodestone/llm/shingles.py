"""Hashed word-shingle sets of texts, vectorised over the bytes of a text."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words in a shingle.
WIDTH = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACES = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, grown to the longest text seen."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(text: bytes, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the words of a text (UTF-8; words end at ASCII white space; ``fold``: A-Z in lower case)."""
    a = np.frombuffer(text.lower() if fold else text, np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _PLACES[63])


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``width`` words.

    With fewer words the whole sequence is the one shingle; no words or no text: an empty set.
    """
    words = word_hashes(text or b"")
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += words[i : n - k + 1 + i] * _PLACES[i]
    return np.unique(mix(total))


def set_digest(hashes: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
