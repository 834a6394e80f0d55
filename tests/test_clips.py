"""Headers by seeking, directories of archives, and clips that appear only when their job commits."""

import os
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from cantora.sources import clips


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("clips")
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 24000, 96000, 4, 16)
    size = (2 << 30) - 4096
    with open(at / "long.wav", "wb") as f:  # two gigabytes of silence that take no room
        f.write(b"RIFF" + struct.pack("<I", size + 60) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + fmt + b"data" + struct.pack("<I", size))
        f.truncate(f.tell() + size)
    (at / "cut.wav").write_bytes(b"RIFF" + struct.pack("<I", 0) + b"WAVE" + fmt + b"data" + struct.pack("<I", 0xFFFFFFF0) + bytes(48000))
    (at / "no.wav").write_bytes(b"RIFFxxxxWAVE")
    (at / "empty.bin").write_bytes(b"")
    for name, files in {"model.pth": ["a/data.pkl", "a/data/0"], "G_100.pth": ["a/data.pkl", "a/optimizer"], "other.zip": ["readme"]}.items():
        with zipfile.ZipFile(at / name, "w") as z:
            z.comment = b"PK not the end" * 100
            for f in files:
                z.writestr(f, "x" * 100_000)
    (at / "D_7.pth").write_bytes(b"no archive")
    return str(at)


def test_headers(spark, folder):
    clips.register(spark)
    rows = spark.read.format("clip_headers").option("path", folder).option("partitions", 3).load()
    got = {os.path.basename(r.path): r for r in rows.collect()}
    long = got["long.wav"]
    assert (long.format, long.rate, long.channels, long.bits, long.bytes) == ("wav", 24000, 2, 16, (2 << 30) - 4096) and long.seconds == pytest.approx(long.bytes / 96000) and long.read < 1000
    assert (got["cut.wav"].bytes, got["cut.wav"].seconds) == (48000, 0.5)
    assert got["no.wav"].format == got["empty.bin"].format == "other" and got["model.pth"].entries == ["a/data.pkl", "a/data/0"] and got["model.pth"].read < 70_000
    said = {os.path.basename(r.path): r.v for r in rows.select("path", clips.model_verdict(F.col("entries"), F.element_at(F.split("path", "/"), -1), F.col("length")).alias("v")).collect()}
    assert {k: said[k] for k in ("model.pth", "G_100.pth", "other.zip", "D_7.pth", "empty.bin")} == {"model.pth": "model", "G_100.pth": "checkpoint", "other.zip": "archive", "D_7.pth": "checkpoint", "empty.bin": "unknown"}


def test_clips_appear_with_their_commit(spark, tmp_path):
    clips.register(spark)
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"c{i}", [0.5] * i, 8000) for i in range(20)] + [("none", None, None)], clips.CLIPS).repartition(4)
    rows.write.format("clips").option("path", out).mode("append").save()
    first = {r.name: r.file for r in clips.committed(spark, out).collect()}
    assert len(first) == 21 and all(os.path.exists(f"{out}/{f}") for f in first.values())

    @F.udf("int")
    def fails(n):
        if n == "c13":
            raise ValueError("midway")
        return 16000

    with pytest.raises(Exception, match="midway"):
        rows.withColumn("rate", fails("name")).write.format("clips").option("path", out).mode("append").save()
    assert {r.name: r.file for r in clips.committed(spark, out).collect()} == first
    clips.sweep(out)  # tasks that ended after the job had failed
    assert sum(len(f) for _, _, f in os.walk(f"{out}/data")) == 21 and clips.sweep(out) == 0
    rows.filter("name = 'c3'").withColumn("rate", F.lit(16000)).write.format("clips").option("path", out).mode("append").save()
    again = {r.name: r.file for r in clips.committed(spark, out).collect()}
    assert again.keys() == first.keys() and {k for k in first if again[k] != first[k]} == {"c3"}
    rows_ = spark.read.format("clip_headers").option("path", f"{out}/data").load()
    assert {(r.rate, r.bytes) for r in rows_.filter(F.col("path").endswith(again["c3"])).collect()} == {(16000, 6)}
