"""Vectorised 64-bit hashes of words and word windows.

A word's hash mixes its length and its bytes, eight at a time (xxh64 from LONG bytes
on); a window's is a Rabin-Karp polynomial over its word hashes modulo the prime
2**61 - 1, built by doubling. Neither loops over bytes or short words in Python, and
neither has structured inputs that agree (as a polynomial modulo a power of two has).
"""

from __future__ import annotations

import numpy as np

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
LONG = 32
PRIME = (1 << 61) - 1
#: Base of the polynomials: any fixed number below the prime.
BASE = 0x0D6E8FEB86659FD9 % PRIME


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of words joined by one space."""
    if not joined:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))


def _runs(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs from ``start`` to ``end``."""
    import xxhash

    blocks = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))  # the eight bytes from each place on
    size = (end - start).astype(np.uint64)
    out = mix(size * _FACTOR)
    for at in range(0, LONG, 8):
        which = slice(None) if at == 0 else np.flatnonzero(size > at)
        left = np.minimum(size[which] - np.uint64(at), np.uint64(8))
        if not len(left):
            break
        own = blocks[start[which] + at] & (np.uint64((1 << 64) - 1) >> (np.uint64(64) - np.uint64(8) * left))
        out[which] = mix(out[which] + own * _FACTOR)
    for k in np.flatnonzero(size >= LONG):
        out[k] = xxhash.xxh64_intdigest(raw[start[k] : end[k]], 1)
    return out


def word_hashes(joined: bytes) -> np.ndarray:
    """One hash for each word of words joined by one space."""
    start, end = spans(joined)
    return _runs(joined, start, end) if len(start) else np.zeros(0, np.uint64)


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """``a * b`` modulo the prime, for numbers below it."""
    low, high = np.uint64(0xFFFFFFFF), np.uint64(32)
    bl, bh = np.uint64(b & 0xFFFFFFFF), np.uint64(b >> 32)
    al, ah = a & low, a >> high
    middle = ah * bl
    middle += al * bh
    ah *= bh
    al *= bl
    # 2**64 is 8, and 2**61 is 1, modulo the prime
    out = (ah << np.uint64(3)) + (middle >> np.uint64(29))
    middle &= np.uint64((1 << 29) - 1)
    out += middle << high
    out += al & np.uint64(PRIME)
    out += al >> np.uint64(61)
    return _reduced(out)


def _reduced(a: np.ndarray) -> np.ndarray:
    """Numbers below 2**64 modulo the prime."""
    a = (a & np.uint64(PRIME)) + (a >> np.uint64(61))
    a -= np.where(a >= np.uint64(PRIME), np.uint64(PRIME), np.uint64(0))
    return a


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0 or size <= 0:
        return np.zeros(0, np.uint64)
    own, length = _reduced(words), 1  # hashes of runs of a power of two
    out, done = None, 0  # and of the binary digits of ``size`` so far
    while True:
        if size & length:
            if out is None:
                out = own
            else:
                m = min(len(out) - length, len(own))
                # the new run comes first, the runs so far follow it
                out = _reduced(own[:m] + _times(out[length : length + m], pow(BASE, length, PRIME)))
            done |= length
        if done == size:
            return mix(out[:n].copy())
        own = _reduced(own[:-length] + _times(own[length:], pow(BASE, length, PRIME)))
        length *= 2


_CLASS = np.full(256, 3, np.uint8)  # punctuation and controls
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 1
_CLASS[65:91] = _CLASS[97:123] = 2
_CLASS[128:] = 2


def token_hashes(text: bytes) -> np.ndarray:
    """One hash for each run of letters (any byte of a non-ASCII character counts as one), digits or other signs."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text, np.uint8)
    kind = _CLASS[raw]
    edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    end = np.append(edge[1:], len(raw))
    own = kind[edge] > 0
    start, end = edge[own], end[own]
    return _runs(text, start, end)
