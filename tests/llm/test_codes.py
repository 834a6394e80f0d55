"""Vector codes against plain Lloyd rounds on Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest


def plain(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest) of each row; rows have distinct ids and one length."""
    kept = [(i, [math.floor(256 * float(x)) if abs(x) < 1e300 else int(x) * 256 for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    side = len(kept[0][1]) // parts
    cut = [[v[p * side : (p + 1) * side] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        at = nearest()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at, strict=True) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = nearest()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in a) for a in at]
    by = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by[lab] = by.get(lab, 0) + e
    most = 2**63 - 1
    return sorted((i, "".join(f"{k:02x}" for _, k in a), min(e, most), min(by[lab], most), digest) for (i, _, lab), a, e in zip(kept, at, errors, strict=True))


def _rows(n, length, seed, ties=False):
    rnd = random.Random(seed)
    draw = (lambda: rnd.choice([-1.0, -0.5, 0.0, 0.25])) if ties else (lambda: rnd.gauss(0, 1))
    return [(3 * i - 100, [draw() for _ in range(length)], rnd.choice([None, 0, 1])) for i in range(n)]


@pytest.mark.parametrize("n, length, ties", [(400, 32, False), (300, 48, True), (20, 16, False)])
def test_codes(spark, n, length, ties, monkeypatch):
    from cantora.llm import codes

    monkeypatch.setattr(codes, "ROWS", 64)
    rows = _rows(n, length, 5, ties)
    odd = [(-500, None, 1), (-400, [None] * length, 1), (-300, [math.nan] * length, 0), (-200, [math.inf] + [0.0] * (length - 1), 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<double>, label int, code string, v int")
    got = codes.compress(df).collect()
    assert sorted(tuple(r) for r in got) == plain(rows)


def test_codes_of_very_large_numbers(spark):
    from cantora.llm.codes import compress

    rows = [(i, [x * s for x in v], lab) for (i, v, lab), s in zip(_rows(90, 16, 7), [1e300, 1e30, 1e7, 1.0, 1e-3] * 18, strict=True)]
    got = compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(tuple(r) for r in got) == plain(rows)


def test_odd_lengths_repeats_and_nothing(spark):
    from cantora.llm.codes import compress

    shape = "vec_id long, embedding array<float>, label string"
    rows = [(1, [float(i % 5)] * 16, "a") for i in range(70)] + [(None, [9.0] * 16, None), (2, [1.0] * 8, "a"), (3, [], "b")]
    got = compress(spark.createDataFrame(rows, shape)).collect()
    assert len(got) == 73 and sorted(r.code is None for r in got)[-2:] == [True, True] and sum(r.code is None for r in got) == 2
    assert {r.error for r in got if r.vec_id == 1} == {0}  # every vector met is an entry
    assert all(r.code is None for r in compress(spark.createDataFrame([(1, [1.0] * 9, "a"), (2, [], "a")], shape)).collect())
    assert compress(spark.createDataFrame([], shape)).count() == 0
    assert compress(spark.createDataFrame([(1, None, "a")], shape)).count() == 0


def test_bounds_spare_most_distances_and_change_nothing():
    from cantora.llm.codes import assign, grouped, squared

    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (64, 4))
    x = centres[rng.integers(0, 64, 5000)] + rng.integers(-200, 200, (5000, 4))
    book, counts = x[:64].copy(), np.zeros(2, np.int64)
    groups = grouped(book)
    code, d, low = assign(x, book, groups, None, None, None)
    for _ in range(4):
        new = np.stack([x[code == k].sum(0) // (code == k).sum() if (code == k).any() else e for k, e in enumerate(book)])
        drift, book = np.sqrt(((new - book) ** 2).sum(1).astype(float)), new
        code, d, low = assign(x, book, groups, code, low.astype(np.float32).astype(float), drift, counts)
        full = squared(x, book)
        assert (code == full.argmin(1)).all() and (d == full.min(1)).all()
        for g in range(low.shape[1]):
            others = np.where((groups == g)[None, :] & (np.arange(64)[None, :] != code[:, None]), full, 2**62).min(1)
            assert (low[:, g] ** 2 <= others).all()
    assert counts[0] < 0.6 * counts[1]
