"""Gain arcs of synthetic sentences whose beat is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantora.operators import arc

HOP = 0.005


def levels(n=600, beat=380):
    """Three seconds of voice with silence at both ends, loudest for 250 ms from `beat`."""
    x = np.where((np.arange(n) >= 40) & (np.arange(n) < 560), 0.2, 0.001)
    x[beat : beat + 50] = 0.8
    return x


@pytest.fixture(scope="module")
def clip(spark):
    x = np.concatenate([levels(), levels(beat=100), np.full(100, 0.5)])
    frames = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x)] + [("other", 0, 1.0), (None, 1, 1.0)], "clip string, at int, level double")
    said = spark.createDataFrame([("c", 0, 0, 600, "cinematic", 8), ("c", 1, 600, 1200, "bedtime", 2), ("c", 2, 1200, 1250, "novel", 9), ("c", 3, 1250, 1252, "cinematic", 9), ("c", 4, 1260, 1260, "cinematic", 9), (None, 0, 0, 9, "bedtime", 9)], "clip string, sentence int, lo int, hi int, style string, words int")
    return frames, said


@pytest.fixture(scope="module")
def got(spark, clip):
    rows = arc.gain_arcs(*clip, arc.styles(spark), "clip", "at", "level", HOP).orderBy("at").collect()
    return {s: [r for r in rows if r.sentence == s] for s in range(5)}


def test_beat_and_shape(got):
    a = got[0]
    assert {r.beat for r in a} == {380} and {r.beat for r in got[1]} == {100}
    db = np.array([r.arc_db for r in a])
    assert abs(db[60] - (-1.35 - 0.21)) < 0.12 and db[350] > db[200] > db[80] and db[379] == pytest.approx(0.45 - 0.21, abs=0.1)
    assert db[540] < -1.8 and db[580] == pytest.approx(-2.3 - 0.21) and abs(db[0]) < 0.3
    short = np.array([r.arc_db for r in got[1]])  # two words where four are asked
    assert short[580] == pytest.approx(-2.15 / 2 + 0.15)
    assert max(r.presence_db for r in a) == pytest.approx(1.85, abs=1e-3) and a[0].presence_db == pytest.approx(0.35, abs=1e-3) and {r.presence_db for r in got[1]} == {0.0}


def test_styles_off_and_short_sentences_stay(got):
    assert {(r.beat, r.arc_db, r.presence_db) for r in got[2] + got[3]} == {(None, 0.0, 0.0)} and len(got[2]) == 50 and len(got[3]) == 2 and not got[4]


def test_smoothing_meets_at_borders(got):
    edge = [r.gain_db for r in got[0][-30:] + got[1][:30]]
    plain = [r.arc_db for r in got[0][-30:] + got[1][:30]]
    assert max(np.abs(np.diff(edge))) < 0.2 < max(np.abs(np.diff(plain)))
    assert got[0][300].gain_db == pytest.approx(got[0][300].arc_db)


def test_blocks_change_nothing(spark, clip, got, monkeypatch):
    monkeypatch.setattr(arc.in_ranges, "__defaults__", (7,))
    monkeypatch.setattr(arc.moving_sum, "__defaults__", (11,))
    rows = arc.gain_arcs(*clip, arc.styles(spark), "clip", "at", "level", HOP).orderBy("at").collect()
    plain = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(plain, rows)) == sorted(plain(r) for s in range(5) for r in got[s])
    assert arc.gain_arcs(clip[0].limit(0), clip[1], arc.styles(spark), "clip", "at", "level", HOP).count() == 0


def test_apply_gain(spark):
    x, g = np.sin(np.arange(1000) / 9.0), [0.0, -6.0, 3.0, 0.0]
    want = x * 10 ** (np.interp(np.arange(1000) / 300, np.arange(4), g) / 20)
    want *= 0.98 / np.abs(want).max()
    df = spark.createDataFrame([(x.tolist(), g), ([], g), (None, g), ([0.1], [])], "x array<double>, g array<double>")
    rows = [r[0] for r in df.select(arc.apply_gain(F.col("x"), F.col("g"), 300)).collect()]
    assert rows[0] == pytest.approx(want.tolist()) and rows[1:] == [[], None, [0.1]]


def test_presence_lifts_its_band_at_the_beat(spark):
    rate = 16000
    t = np.arange(2 * rate) / rate
    x = 0.1 * np.sin(2 * np.pi * 3000 * t) + 0.1 * np.sin(2 * np.pi * 500 * t)
    df = spark.createDataFrame([(x.tolist(), 0.5, 6.0), (x.tolist(), None, 6.0), ([], 0.5, 1.0), (None, 0.5, 1.0)], "x array<double>, at double, db double")
    y, same, *rest = [r[0] for r in df.select(arc.lifted("x", F.lit(rate), "at", F.lit(0.0), "db")).collect()]

    def level(y, f, lo):
        seg = np.array(y)[int(lo * rate) : int((lo + 0.1) * rate)]
        return np.abs((seg * np.exp(-2j * np.pi * f * t[: len(seg)])).mean())

    assert level(y, 3000, 0.45) == pytest.approx(level(x, 3000, 0.45) * 10 ** (6 / 20), rel=0.05)
    assert level(y, 3000, 1.7) == pytest.approx(level(x, 3000, 1.7), rel=0.02) and level(y, 500, 0.45) == pytest.approx(level(x, 500, 0.45), rel=0.02)
    assert same == x.tolist() and rest == [[], None] and len(y) == len(x)
