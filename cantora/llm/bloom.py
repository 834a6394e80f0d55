"""Segmented Bloom filters of bounded size: each task fills the segments of its own keys; the driver joins the segments' bits."""

from __future__ import annotations

import numpy as np

from .arrays import U

#: Segments are told apart by a key's top bits.
SEGMENT_BITS = 8
PROBES = 4


def bits_for(keys: int, per_key: int, most: int) -> int:
    """Bits of one segment: a power of two, so that the whole filter has per_key bits a key and `most` bits at most."""
    most = max(most, 1 << (SEGMENT_BITS + 9))
    want = max(1 << (SEGMENT_BITS + 9), min(most, keys * per_key))
    total = 1 << int(want - 1).bit_length()
    return min(total, 1 << (most.bit_length() - 1)) >> SEGMENT_BITS


def _places(keys: np.ndarray, bits: int, j: int) -> np.ndarray:
    a, b = keys * U(0x9FB21C651E98DF25), (keys >> U(17)) * U(0xD6E8FEB86659FD93) | U(1)
    return ((keys >> U(64 - SEGMENT_BITS)) * U(bits) + (((a + U(j) * b) >> U(20)) & U(bits - 1))).astype(np.int64)


def has(keys: np.ndarray, bits: int, filled: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    live = np.arange(len(keys))
    for j in range(PROBES):
        at = _places(keys[live], bits, j)
        hit = (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        out[live[~hit]] = False
        live = live[hit]
    return out


def segments(keys: np.ndarray, bits: int):
    """(segment, its bits) for the segments that keys fall into."""
    seg = (keys >> U(64 - SEGMENT_BITS)).astype(np.int64)
    for s in np.unique(seg):
        own = keys[seg == s]
        filled = np.zeros(bits, bool)
        for j in range(PROBES):
            filled[_places(own, bits, j) - int(s) * bits] = True
        yield int(s), np.packbits(filled, bitorder="little").tobytes()


def joined(rows, bits: int) -> np.ndarray:
    """The whole filter from (segment, bits) rows."""
    whole = np.zeros((1 << SEGMENT_BITS, bits // 8), np.uint8)
    for s, filled in rows:
        whole[s] |= np.frombuffer(filled, np.uint8)
    return whole.reshape(-1)
