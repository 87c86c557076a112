"""Vectorised 64-bit hashing of words and windows in the bytes of an Arrow array.

Hashes are polynomials modulo 2^64 with an odd base over a table of mixed values of bytes. Prefix sums
give the hash of any range in constant time: the difference of two prefixes times a power of the
base's inverse. Chosen long words can collide modulo 2^64 whatever the base, so words of ``LONG_WORD``
bytes or more have a cryptographic hash instead.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n well mixed odd words."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


@lru_cache(maxsize=4)
def byte_table(seed: int = 1) -> np.ndarray:
    return constants(256, seed * 1000)


_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1), or the same of the base's inverse."""
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(steps)
        _powers[inverse] = have
    return have[:n]


def prefixes(flat: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One more prefix hash than there are bytes."""
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(table[flat] * powers(len(flat)), out=out[1:])
    return out


def ranges(prefix: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Mixed hashes of the byte ranges; equal ranges have equal ones wherever they are."""
    return mix((prefix[stops] - prefix[starts]) * powers(len(prefix), True)[starts])


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are hashed at once; longer texts are cut at white space.
PIECE = 1 << 18
LONG_WORD = 128


def word_hashes(flat: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes that are no ASCII white space) and where each row's begin and the last's end."""
    table = byte_table()[_LOWER] if lower else byte_table()
    found, places = [], []
    start = 0
    while start < len(flat):
        stop = min(start + PIECE, len(flat))
        while stop < len(flat) and not _SPACE[flat[stop]]:
            nxt = np.flatnonzero(_SPACE[flat[stop : stop + PIECE]])
            stop = stop + int(nxt[0]) if len(nxt) else min(stop + PIECE, len(flat))
        piece = flat[start:stop]
        word = ~_SPACE[piece]
        cut = ends[(ends > start) & (ends < stop)] - start
        first = word.copy()
        first[1:] &= ~word[:-1]
        first[cut] = word[cut]
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[cut - 1] = word[cut - 1]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(a):
            found.append(ranges(prefixes(piece, table), a, b))
            for k in np.flatnonzero(b - a >= LONG_WORD).tolist():
                word = piece[a[k] : b[k]]
                word = (_LOWER[word] if lower else word).tobytes()
                found[-1][k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            places.append(a + start)
        start = stop
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(places), ends)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one row; of the whole row if it has fewer; none of none."""
    if not len(words):
        return words
    factors = constants(width + 1, 77)
    if len(words) < width:
        return mix((words * factors[: len(words)]).sum(keepdims=True) + np.uint64(len(words)) * factors[width])
    n = len(words) - width + 1
    total = words[:n] * factors[0]
    for k in range(1, width):
        total = total + words[k : k + n] * factors[k]
    return mix(total)
