"""Vectorised hashing over concatenated texts: words, polynomial range hashes, sliding minima."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LONG_WORD = 64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept between calls."""
    if len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h = h * U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def prefix(sym: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sym) + 1, np.uint64)
    np.cumsum(sym * powers(len(sym))[0], out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run [start, end) of the symbols behind sums."""
    inv = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


def every(sums: np.ndarray, size: int) -> np.ndarray:
    """ranges of all runs of `size` symbols."""
    n = len(sums) - size
    return mix((sums[size:] - sums[:n]) * powers(len(sums))[1][:n] + U(size))


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without white space) of the texts raw[off[i]:off[i+1]]: starts, ends, and the first word's index of each text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~WHITE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word: its length, then eight bytes after eight, each mixed into what came before. Words over LONG_WORD bytes are digested."""
    n = ends - starts
    out = mix(n.astype(np.uint64) * _BASE)
    at = np.arange(len(n))
    for k in range(0, LONG_WORD, 8):
        at = at[n[at] > k] if k else at[(n > 0) & (n <= LONG_WORD)]
        if not len(at):
            break
        place, left = starts[at] + k, n[at] - k
        block = np.zeros(len(at), np.uint64)
        for j in range(8):
            own = raw[np.minimum(place + j, len(raw) - 1)].astype(np.uint64) << U(8 * j)
            block |= np.where(left > j, own, U(0))
        out[at] = mix(out[at] ^ block)
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w entries, by doubling."""
    have = 1
    while have * 2 <= w:
        a = np.minimum(a[: len(a) - have], a[have:])
        have *= 2
    return np.minimum(a[: len(a) - (w - have)], a[w - have :]) if w > have else a


def least_places(seeds: np.ndarray, wide: int, position_bits: int = 24) -> np.ndarray:
    """Place of the least seed (by its upper bits, then its place) of each run of `wide` seeds, in pieces whose places fit position_bits."""
    mask, step = U((1 << position_bits) - 1), (1 << position_bits) - wide + 1
    out = np.empty(max(0, len(seeds) - wide + 1), np.int64)
    for lo in range(0, len(out), step):
        piece = seeds[lo : lo + step + wide - 1]
        key = (piece & ~mask) | np.arange(len(piece), dtype=np.uint64)
        out[lo : lo + step] = lo + (sliding_min(key, wide) & mask).astype(np.int64)
    return out


def runs(*cols: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run in which cols stay and step grows by one."""
    n = len(step)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = step[1:] != step[:-1] + 1
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


def firsts(*cols: np.ndarray) -> np.ndarray:
    """For sorted columns: True where any differs from the row before."""
    new = np.ones(len(cols[0]), bool)
    if len(new):
        new[1:] = False
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return new


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... count[0] values; then those of the next run."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(first - before, count)
