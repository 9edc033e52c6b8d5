"""Hashes of byte strings, for whole arrays at once.

``segment_hashes`` tells strings of any length apart: two polynomials modulo the prime 2**31 - 1.
``prefix_sums`` and ``powers`` are a polynomial modulo 2**64, which is faster to roll, for strings of some
dozen bytes only: modulo a power of two, a Thue-Morse word of 1024 letters or more and its complement have the same
value, whatever the base.
"""

from __future__ import annotations

import numpy as np

BASE, MIX1, MIX2 = 0x9E3779B97F4A7C15 | 1, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
PRIME, BASES = (1 << 31) - 1, (1_234_567_891, 987_654_323)
#: Powers are held for as many bytes at least.
LEAST = (1 << 18) + 4096
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))
_prime_powers: dict[int, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(max(n, LEAST), base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = both[0], both[1]
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray, by: int = MIX1) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(by)
    h ^= h >> np.uint64(29)
    h *= np.uint64(MIX2)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the hash of data[i:j] times BASE**i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=out[1:])
    return out


def _folded(h: np.ndarray) -> np.ndarray:
    """The same modulo PRIME, in 33 bits at most."""
    return (h & np.uint64(PRIME)) + (h >> np.uint64(31))


def _modulo(h: np.ndarray) -> np.ndarray:
    h = _folded(_folded(_folded(h)))
    return np.where(h >= PRIME, h - np.uint64(PRIME), h)


def prime_powers(base: int, n: int) -> np.ndarray:
    """Powers of base modulo PRIME, by doubling; as many are held as are asked for, to the next 2**16, in 32 bits."""
    known = _prime_powers.get(base, np.ones(1, np.uint32))
    if len(known) < n:
        most = max(n, LEAST) + 65535 >> 16 << 16
        while len(known) < most:
            step = np.uint64(pow(base, len(known), PRIME))
            known = np.concatenate([known, _modulo(known[: most - len(known)].astype(np.uint64) * step).astype(np.uint32)])
        _prime_powers[base] = known
    return known[:n]


def segment_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, by: int = MIX1) -> np.ndarray:
    """A 64-bit hash of each data[start:stop]."""
    whole, values = np.zeros(len(starts), np.uint64), data.astype(np.uint64) + np.uint64(1)
    for base in BASES:
        sums = np.zeros(len(data) + 1, np.uint64)
        terms = values * prime_powers(base, len(data))  # under 2**40: sums of so many need no modulo
        np.cumsum(terms if len(data) < 1 << 23 else _folded(terms), out=sums[1:])
        back = prime_powers(pow(base, -1, PRIME), len(data) + 1)[starts]
        whole = (whole << np.uint64(32)) + _modulo(_modulo(sums[stops] - sums[starts]) * back)
    return mixed(whole + (stops - starts).astype(np.uint64) * np.uint64(BASE), by)
