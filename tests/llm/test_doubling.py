"""A part of the prefix doubling that holds many places, worked on slice by slice."""

import tracemalloc

import numpy as np

from cantora.llm import doubling


def _answers(entries, places, at_once, monkeypatch, last):
    """(answer of each place, peak bytes a place) of one part with `entries` runs of places of random keys."""
    monkeypatch.setattr(doubling, "AT_ONCE", at_once)
    rng = np.random.default_rng(7)
    n = np.full(entries, places // entries, np.int32)
    rank, p = np.sort(rng.integers(0, 50, entries)).astype(np.int32), (np.arange(entries) * 1000).astype(np.int32)
    ids, at = rng.integers(0, 400, entries), rng.integers(0, 9, entries).astype(np.int32)
    key = np.repeat(rng.integers(0, entries // 2, entries).astype(np.uint64) << np.uint64(32), n) + np.tile(np.arange(n[0], dtype=np.uint64), entries)
    tracemalloc.start()
    out = []
    for batch in doubling.Doubling()._named(np.arange(50) + 7, rank, p, n, rng.random(entries) < 0.1, ids, at, key, last):
        for row in batch.to_pylist():
            place, size, name, begin, _ = doubling._columns([row], ("i4", "i4", "i8", "i4"))
            out += [(row["to"], a + k, x, b + k) for a, c, x, b in zip(place.tolist(), size.tolist(), name.tolist(), begin.tolist(), strict=True) for k in range(c)] if places < 1 << 16 else []
    peak = tracemalloc.get_traced_memory()[1] / places
    tracemalloc.stop()
    return sorted(out), peak


def test_slices_give_the_same_names(monkeypatch):
    for last in (False, True):
        whole = _answers(500, 10_000, 1 << 20, monkeypatch, last)[0]
        assert whole and whole == _answers(500, 10_000, 300, monkeypatch, last)[0]


def test_a_large_part_takes_few_bytes_a_place(monkeypatch):
    assert _answers(50_000, 4_000_000, 1 << 18, monkeypatch, False)[1] < 50


def test_prefixes_of_some_entries_at_a_time(monkeypatch):
    own = doubling.Doubling()
    rng = np.random.default_rng(3)
    n = rng.integers(1, 90, 300).astype(np.int32)
    raw = rng.integers(97, 99, int((n + own.start - 1).sum())).astype(np.uint8)
    whole = own._prefixes(raw, n)
    monkeypatch.setattr(doubling, "AT_ONCE", 200)
    assert (own._prefixes(raw, n) == whole).all()
