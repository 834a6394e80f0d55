"""Streams, sources and sinks on small inputs."""

import json
import os
import struct
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantora.operators import ledger
from cantora.sources import files, media
from cantora.streaming import jobs


def streamed(spark, tmp_path, rows, shape, run):
    """Rows that a stream has written after each list of rows came as one micro-batch."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
        os.makedirs(tmp_path / "flat", exist_ok=True)
        for f in (tmp_path / "in" / str(i)).glob("*.parquet"):
            os.rename(f, tmp_path / "flat" / f"{i}.parquet")
    src = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    out = str(tmp_path / "out")
    # with processing-time timers a query does not end by itself: it is stopped once it has seen every file
    q = run(src).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).start()
    files_, until = len(list((tmp_path / "flat").glob("*.parquet"))), time.time() + 60
    while time.time() < until and not any(json.loads(str(p["sources"][0]["endOffset"] or "{}").replace("'", chr(34))).get("logOffset", -1) >= files_ - 1 for p in q.recentProgress):
        time.sleep(0.2)
    q.stop()
    return spark.read.parquet(out).collect()


def test_batches_stream_is_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    lines = [(k, i, float(rng.integers(1, 30)), False) for i in range(60) for k in ("a", "b")] + [(k, 60, 2.0, True) for k in ("a", "b")]
    shape = "k string, pos int, s double, end boolean"
    got = streamed(spark, tmp_path, [lines[i : i + 20] for i in range(0, 122, 20)], shape, lambda d: jobs.batches(d, "k", "pos", "s", last="end"))
    want = ledger.batches(spark.createDataFrame(lines, shape), "k", ["pos"], "s").collect()
    assert {(r.k, r.batch, r.n, round(r.total, 4)) for r in got} == {(r.k, r.batch, r.n, r.total) for r in want} and len(got) == len(want)


def test_restarted_streams_go_on_from_their_state(spark, tmp_path):
    rng = np.random.default_rng(5)
    lines = [("a", i, float(rng.integers(1, 30)), i == 39) for i in range(40)]
    shape = "k string, pos int, s double, end boolean"
    for name, run in {"batched": lambda d: jobs.batches(d, "k", "pos", "s", last="end"), "ordered": lambda d: jobs.in_order(d, "k", "pos", "s")}.items():
        at = tmp_path / name
        order = lines if name == "batched" else [lines[i] for i in rng.permutation(40)]
        streamed(spark, at, [order[:7], order[7:20]], shape, run)
        # more files, the same checkpoint: the second query has nothing but what the first one stored
        spark.createDataFrame(order[20:], shape).coalesce(1).write.parquet(str(at / "more"))
        for f in (at / "more").glob("*.parquet"):
            os.rename(f, at / "flat" / "9.parquet")
        got = streamed(spark, at, [], shape, run)
        if name == "ordered":
            assert [r.pos for r in sorted(got, key=lambda r: r.pos)] == list(range(40))
        else:
            want = ledger.batches(spark.createDataFrame(lines, shape), "k", ["pos"], "s").collect()
            assert sorted((r.batch, r.n, round(r.total, 4)) for r in got) == sorted((r.batch, r.n, r.total) for r in want)


def test_waiting_lines_are_given_out_by_a_timer(spark, tmp_path):
    shape = "k string, pos int, s double"
    spark.createDataFrame([("a", 0, 3.0), ("a", 1, 4.0)], shape).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    q = jobs.batches(src, "k", "pos", "s", wait_ms=500).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 60
    while time.time() < until and not any((tmp_path / "out").glob("*.parquet")):
        time.sleep(0.5)
    time.sleep(3)
    q.stop()
    assert [(r.k, r.batch, r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 0, 2, 7.0)]


def test_lines_in_order(spark, tmp_path):
    rows = [[("j", 2, "c"), ("j", 0, "a")], [("j", 3, "d")], [("j", 1, "b")], [("j", 5, "f")]]
    got = streamed(spark, tmp_path, rows, "job string, pos long, v string", lambda d: jobs.in_order(d, "job", "pos", "v"))
    assert sorted((r.pos, r.v) for r in got) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_statuses(spark, tmp_path):
    rows = [[("j", "working"), ("k", "working")], [("j", "working")], [("j", "done")]]
    got = streamed(spark, tmp_path, rows, "job string, s string", lambda d: jobs.statuses(d, "job", "s", ttl_ms=3_600_000))
    assert sorted((r.job, r.state, r.gone) for r in got) == [("j", "done", False), ("j", "working", False), ("k", "working", False)]


def test_breakers(spark, tmp_path):
    calls = [[("p", 0.0, True, False), ("p", 10.0, False, True)], [("p", 60.0, False, False), ("p", 200.0, True, False)]]
    got = streamed(spark, tmp_path, calls, "p string, at double, ok boolean, refused boolean", lambda d: jobs.breakers(d, "p", "at", "ok", "refused"))
    assert sorted((r["at"], r.open, r.width) for r in got) == [(0.0, False, 6), (10.0, False, 6), (60.0, True, 3), (200.0, False, 1)]


def test_retries_and_cancel(spark, tmp_path):
    waits, left = [], [2]

    def flaky():
        left[0] -= 1
        if left[0] >= 0:
            raise ValueError("not yet")
        return 7

    assert jobs.retried(flaky, sleep=waits.append) == (7, 3, None) and waits == [3.0, 6.0]
    assert jobs.retried(lambda: 1 / 0, retries=1, sleep=waits.append)[:2] == (None, 2)
    q = spark.readStream.format("rate").load().writeStream.format("memory").queryName("rate").option("checkpointLocation", str(tmp_path / "cp")).start()
    stop = threading.Event()
    stop.set()
    assert not jobs.run_until(q, stop) and not q.isActive


def mp3(frames, rate_bits=0, kbps_index=9, version=3):
    head = bytes([0xFF, 0xE0 | version << 3 | 1 << 1 | 1, kbps_index << 4 | rate_bits << 2, 0])
    size = int((1152 if version == 3 else 576) / 8 * ([0, 32, 40, 48, 56, 64, 80, 96, 112, 128] if version == 3 else [0, 8, 16, 24, 32, 40, 48, 56, 64, 80])[kbps_index] * 1000 / {3: [44100, 48000], 2: [22050, 24000]}[version][rate_bits])
    return (head + bytes(size - 4)) * frames


def test_headers(spark):
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 24000, 96000, 4, 16)
    listed = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", 96000) + bytes(96000)
    open_end = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + fmt + b"data" + struct.pack("<I", 0xFFFFFFF0) + bytes(48000)
    rows = spark.createDataFrame([(0, bytearray(listed)), (1, bytearray(open_end)), (2, bytearray(b"no")), (3, None)], "k int, content binary")
    got = {r.k: (r.i.rate, r.i.channels, r.i.bytes, r.i.seconds) for r in rows.select("k", media.wav_info(F.col("content")).alias("i")).collect()}
    assert got == {0: (24000, 2, 96000, 1.0), 1: (24000, 2, 48000, 0.5), 2: (0, 1, 0, 0.0), 3: (0, 1, 0, 0.0)}
    sounds = [(0, bytearray(b"junk" + mp3(101))), (1, bytearray(mp3(51, 1, 6, 2))), (2, bytearray(bytes(48000))), (3, bytearray(b"short")), (4, None)]
    got = {r.k: r.s for r in spark.createDataFrame(sounds, "k int, c binary").select("k", media.mp3_seconds(F.col("c")).alias("s")).collect()}
    assert got[0] == pytest.approx(100 * 1152 / 44100) and got[1] == pytest.approx(50 * 576 / 24000) and got[2] == 8.0 and got[3] == 0.0 and got[4] == 0.0


def test_clips_go_out_and_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", [0.0, 0.5, -0.5, 2.0], 8000), ("b", [], 24000)], "name string, x array<double>, sr int")
    for _ in range(2):
        media.write_clips(rows, "name", "x", "sr", str(tmp_path / "out"))
    got = {r.path.rsplit("/", 1)[1]: (r.sr, [round(v, 3) for v in r.samples]) for r in files.clips(spark, str(tmp_path / "out")).collect()}
    assert got == {"a.wav": (8000, [0.0, 0.5, -0.5, 1.0]), "b.wav": (24000, [])} and sorted(os.listdir(tmp_path / "out")) == ["a.wav", "b.wav"]


def test_folders_are_searched(spark, tmp_path):
    for f in ("r1/infer/x.py", "r1/assets/weights/Voice-kh.pth", "r1/assets/indices/v.index", "r1/logs/kh/G_200.pth", "r2/RVC.py", "r2/weights/old.pth", "other/readme.txt", "r1/.hidden/y.pth"):
        os.makedirs((tmp_path / f).parent, exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    found = media.files(spark, str(tmp_path))
    got = {r.dir.rsplit("/", 1)[1]: (r.layout, r.models, r.indices, r.checkpoints) for r in media.installs(found).collect()}
    assert got == {"r1": ("modern", ["assets/weights/Voice-kh.pth"], ["assets/indices/v.index"], ["logs/kh/G_200.pth"]), "r2": ("classic", ["weights/old.pth"], [], [])}
    wanted = spark.createDataFrame([(1, "assets/weights/voice-kh.pth"), (2, "Voice"), (3, "missing"), (4, "")], "key int, value string")
    got = {r.key: (r.path and r.path.rsplit("/", 1)[1], r.how) for r in media.resolved(wanted, found, [".pth"]).collect()}
    assert got == {1: ("Voice-kh.pth", 2), 2: ("Voice-kh.pth", 4), 3: (None, None), 4: (None, None)}


def test_small_files(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    assert files.config(spark, at("config.json"), {"a": 1, "b": {"c": 2}}) == {"a": 1, "b": {"c": 2}}
    (tmp_path / "own.json").write_text(json.dumps({"b": {"d": 3}, "e": 4}))
    assert files.config(spark, at("own.json"), {"a": 1, "b": {"c": 2}}) == {"a": 1, "b": {"d": 3}, "e": 4}
    (tmp_path / "log.json").write_text('{"cid": "a", "tts": "success"}\n{broken\n')
    good = files.restart(spark, at("log.json"), at("corrupt"))
    assert good.count() == 1 and [r.value for r in spark.read.text(at("corrupt")).collect()] == ["{broken"]
    files.save_ledger(good, at("log2"))
    assert [r.tts for r in files.ledger(spark, at("log2"))[0].collect()] == ["success"]
    rules = spark.createDataFrame([("words", "x", "ex"), ("repetition_bases", "b", None), ("numbers", "1", "one")], "kind string, term string, spoken string")
    files.save_lexicon(rules, at("lex"))
    assert {tuple(r) for r in files.lexicon(spark, at("lex")).collect()} == {tuple(r) for r in rules.collect()}
    (tmp_path / "v.json").write_text(json.dumps([{"ShortName": "km-A", "Locale": "km-KH", "Gender": "Female", "FriendlyName": "A"}, {"ShortName": "km-B", "Locale": "km-KH"}]))
    assert [tuple(r) for r in media.voices(spark, at("v.json")).collect()] == [("km-A", "km-KH", "Female", "A"), ("km-B", "km-KH", "", "km-B")]
    (tmp_path / "i.tsv").write_text("a\tone\ttwo\nalone\n")
    (tmp_path / "i.csv").write_text('a,"one, two",three\nalone\n')
    assert [tuple(r) for r in files.pair_table(spark, at("i.tsv")).collect()] == [("a", "one\ttwo")] and [tuple(r) for r in files.pair_table(spark, at("i.csv"), tab=False).collect()] == [("a", "one, two,three")]
    os.makedirs(tmp_path / "p" / "q")
    (tmp_path / "p/q/one.wav").write_bytes(b"x"), (tmp_path / "p/q/one.txt").write_text(" said \n"), (tmp_path / "p/two.wav").write_bytes(b"x")
    assert [(r.stem, r.text.strip()) for r in files.folder_pairs(spark, at("p")).collect()] == [("one", "said")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "chapter int, text string")
    out = str(tmp_path / "out")
    for _ in range(2):
        files.write_chunks(rows, out, add=True)
    assert spark.read.text(out).count() == 2
    files.write_chunks(rows.filter("chapter = 1"), out)
    assert spark.read.text(out).count() == 1
    report = files.changes_report(spark.createDataFrame([(1, "One", 9, 8, 2, 1, 3, 0)], "chapter int, title string, before int, after int, sentences int, chunks int, time int, date int"), ["time", "date"])
    assert report.first().line == "chapter 1 — One: 9 chars -> 8 chars, 2 sentences, 1 chunks\n    rules: time x3"
    kept, out = spark.createDataFrame([(30.0,), (60.0,)], "seconds double"), spark.createDataFrame([("a", "too short")], "label string, reason string")
    assert tuple(files.pairs_report(kept, out).first()) == (2, 1.5, 45.0, 1, ["a: too short"])
    assert spark.range(1).select(files.with_defaults(F.lit('{"a": 1}'), {"a": 9, "b": 2}).alias("x"), files.json_field(F.lit('{"a": 1}'), "$.b", 5).alias("y")).first() == ('{"a":"1","b":"2"}', 5)
