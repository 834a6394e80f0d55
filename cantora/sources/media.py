"""Media files: headers walked without decoding, WAV files written, folders searched for models."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantora.operators.curate import checkpoint_name


def _wav(data: bytes) -> dict:
    """What a RIFF file's chunks say, in whatever order they come; a length that runs past the end (a stream) is what is there; without a data chunk what follows 44 bytes counts. Zeros for anything else."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return {"rate": 0, "offset": 0, "bytes": 0, "channels": 1, "bits": 16}
    rate, channels, bits, at = 0, 1, 16, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(data):
            channels, rate = struct.unpack_from("<HI", data, at + 10)
            bits = struct.unpack_from("<H", data, at + 22)[0] or 16
        elif name == b"data":
            whole = len(data) - at - 8
            return {"rate": rate, "offset": at + 8, "bytes": size if 0 < size <= whole else whole, "channels": channels or 1, "bits": bits}
        at += 8 + size + size % 2
    return {"rate": rate, "offset": 44, "bytes": max(0, len(data) - 44), "channels": channels or 1, "bits": bits}


_WAV = [("rate", T.IntegerType(), pa.int32()), ("offset", T.LongType(), pa.int64()), ("bytes", T.LongType(), pa.int64()), ("channels", T.IntegerType(), pa.int32()), ("bits", T.IntegerType(), pa.int32())]


def wav_info(content: Column) -> Column:
    """rate, offset and bytes of the samples, channels, bits and seconds of a WAV file's content."""

    @F.arrow_udf(T.StructType([T.StructField(n, t) for n, t, _ in _WAV]))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_wav(x or b"") for x in batch.to_pylist()], pa.struct([(n, t) for n, _, t in _WAV]))

    info = run(content)
    frame = info["rate"] * info["channels"] * F.greatest(F.lit(1), F.floor(info["bits"] / 8))
    return info.withField("seconds", F.when((info["rate"] > 0) & (info["bytes"] > 0), info["bytes"] / frame).otherwise(0.0))


# fixed values: bit rates (kbit/s) of layer III by version; sample rates by version code (2.5 is not read)
_BITRATES = {1: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], 2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000]}


def mp3_frames(data: bytes) -> tuple[int, int, int]:
    """(frames, samples of a frame, sample rate) of a layer III stream, header by header; what is no header is stepped over."""
    at = frames = samples = rate = 0
    while at + 4 <= len(data):
        a, b, c = data[at], data[at + 1], data[at + 2]
        version, bits, speed = b >> 3 & 3, c >> 4, c >> 2 & 3
        if a != 255 or b >> 5 != 7 or version not in _RATES or b >> 1 & 3 != 1 or bits in (0, 15) or speed == 3:
            at += 1
            continue
        own = 1152 if version == 3 else 576
        size = int(own / 8 * _BITRATES[1 if version == 3 else 2][bits] * 1000 / _RATES[version][speed]) + (c >> 1 & 1)
        if size <= 4:
            at += 1
            continue
        frames, samples, rate, at = frames + 1, own, _RATES[version][speed], at + size
    return frames, samples, rate


def _mp3_seconds(data: bytes) -> float:
    if len(data) < 2000:
        return 0.0
    frames, samples, rate = mp3_frames(data)
    return (frames - 1) * samples / rate if frames >= 2 else len(data) * 8 / 48000.0


def mp3_seconds(content: Column) -> Column:
    """Length of an MP3 file: its frames but the first, which holds no sound; by bytes at 48 kbit/s where no frames are found; 0 under 2000 bytes."""

    @F.arrow_udf(T.DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_mp3_seconds(x or b"") for x in batch.to_pylist()], pa.float64())

    return run(content)


def wav_content(samples: Column, rate: Column) -> Column:
    """A 16-bit mono WAV file of samples from -1 to 1, cut at full scale."""

    @F.arrow_udf(T.BinaryType())
    def run(cols: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for arrays, rates in cols:
            out = []
            for x, r in zip(arrays.to_pylist(), rates.to_pylist(), strict=True):
                sink = io.BytesIO()
                with wave.open(sink, "wb") as w:
                    w.setnchannels(1), w.setsampwidth(2), w.setframerate(int(r)), w.writeframes((np.clip(np.array(x or [], float), -1, 1) * 32767).astype("<i2").tobytes())
                out.append(sink.getvalue())
            yield pa.array(out, pa.binary())

    return run(samples, rate)


def write_clips(clips: DataFrame, name: str, samples: str, rate: str, path: str) -> None:
    """One WAV file a row, written by the tasks to a folder that they share; a file is written aside and renamed, so a task that runs twice leaves one whole file."""
    import os
    import uuid

    def put(batches):
        os.makedirs(path, exist_ok=True)
        for batch in batches:
            for n, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                aside = os.path.join(path, f".{uuid.uuid4().hex}")
                with open(aside, "wb") as f:
                    f.write(content)
                os.replace(aside, os.path.join(path, f"{n}.wav"))
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    clips.select(F.col(name).cast("string"), wav_content(F.col(samples), F.col(rate))).mapInArrow(put, "n long").agg(F.sum("n")).collect()


def files(spark: SparkSession, root: str, depth: int = 6) -> DataFrame:
    """path, folder, name, ext, bytes, modified of the files under a folder, `depth` folders down at most; hidden ones are left out. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    rows = found.withColumn("p", F.regexp_replace("path", "^file:/*", "/")).withColumn("_b", F.split(F.expr(f"substring(p, {len(root.rstrip('/')) + 2})"), "/"))
    name = F.element_at("_b", -1)
    return rows.filter((F.size("_b") <= depth + 1) & ~F.exists("_b", lambda x: x.startswith("."))).select(F.col("p").alias("path"), F.array_join(F.slice("_b", F.lit(1), F.size("_b") - 1), "/").alias("folder"), name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("ext"), "bytes", "modified")


def installs(found: DataFrame, most: int = 8) -> DataFrame:
    """dir, layout, models, indices, checkpoints of folders that can convert voices, by their marks: `infer` or `RVC.py`, with `assets/weights` (modern) or `weights` (classic). The first `most` by name."""
    parts = F.regexp_extract("path", r"^(.*?)/(infer/|RVC\.py$)", 1)
    homes = found.withColumn("dir", parts).filter("dir != ''").select("dir").distinct().orderBy("dir").limit(most).withColumnRenamed("dir", "_dir")
    own = found.join(F.broadcast(homes), F.col("path").startswith(F.concat("_dir", F.lit("/"))))  # `most` rows
    rel = F.expr("substring(path, length(_dir) + 2)")
    rows = own.withColumn("_rel", rel)
    pick = lambda cond, n: F.slice(F.array_sort(F.collect_set(F.when(cond, F.col("_rel")))), 1, n)
    modern, model = F.col("_rel").startswith("assets/weights/"), F.col("ext") == ".pth"
    return rows.groupBy(F.col("_dir").alias("dir")).agg(
        F.when(F.bool_or(modern), "modern").when(F.bool_or(F.col("_rel").startswith("weights/")), "classic").when(F.bool_or(F.col("_rel").startswith("infer/")), "modern").otherwise("classic").alias("layout"),
        pick(model & F.col("_rel").rlike(r"^(assets/)?weights/[^/]+$"), 20).alias("models"), pick((F.col("ext") == ".index") & F.col("_rel").rlike("^(assets/indices|logs)/"), 40).alias("indices"),
        pick(model & F.col("_rel").startswith("logs/") & checkpoint_name(F.col("name")), 20).alias("checkpoints"),
    )


def resolved(wanted: DataFrame, found: DataFrame, exts: list[str]) -> DataFrame:
    """wanted (key, value) with the file that a pasted value means: the path itself; a file of that name; one whose name holds its stem; the newest of the folder it names. The best match wins, then the newest file, then the name."""
    value = F.lower(F.col("value"))
    base = F.element_at(F.split(value, "/"), -1)
    stem = F.regexp_replace(base, r"\.[^.]+$", "")
    path, name = F.lower("path"), F.lower("name")
    rank = F.when(path == value, 1).when(path.endswith(F.concat(F.lit("/"), value)), 2).when(name == base, 3).when((stem != "") & name.contains(stem), 4).when(path.startswith(F.concat(F.regexp_replace(value, "/+$", ""), F.lit("/"))), 5)
    rows = wanted.filter("value != ''").join(F.broadcast(found.filter(F.col("ext").isin(*exts))), rank.isNotNull(), "inner").withColumn("how", rank)  # the files of one folder search
    best = rows.withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy("how", F.desc("modified"), "name", "path"))).filter("_r = 1")
    return wanted.join(best.select(F.col("key").alias("_key"), "path", "how"), F.col("key") == F.col("_key"), "left").drop("_key")


def voices(spark: SparkSession, path: str) -> DataFrame:
    """id, locale, gender, name of a provider's list of voices (one JSON array)."""
    shape = "array<struct<ShortName:string,Locale:string,Gender:string,FriendlyName:string,id:string,locale:string,gender:string,name:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", shape)))
    rows = raw.toDF("short", "loc", "gen", "friendly", "id", "locale", "gender", "name")
    return rows.select(F.coalesce("short", "id").alias("id"), F.coalesce("loc", "locale").alias("locale"), F.coalesce("gen", "gender", F.lit("")).alias("gender"), F.coalesce("friendly", "name", "short", "id").alias("name"))
