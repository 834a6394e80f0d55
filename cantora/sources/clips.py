"""Clips as a data source: headers read by seeking, and a writer whose files count only once its job commits. Works wherever pyarrow's file systems do."""

from __future__ import annotations

import io
import json
import struct
import uuid
import wave
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyarrow import fs as afs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEADERS = "path string, length long, format string, rate int, channels int, bits int, bytes long, seconds double, entries array<string>, read long"
CLIPS = "name string, samples array<double>, rate int"


def _open(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class _Seeker:
    """Byte ranges of one file, and how much of it was read."""

    def __init__(self, at: afs.FileSystem, path: str, length: int):
        self.file, self.length, self.read = at.open_input_file(path), length, 0

    def bytes(self, start: int, size: int) -> bytes:
        if start < 0 or start >= self.length:
            return b""
        self.file.seek(start)
        got = self.file.read(min(size, self.length - start))
        self.read += len(got)
        return got


def wav_header(f: _Seeker) -> dict | None:
    """A RIFF file's chunks from one header to the next: rate, channels, bits, bytes of sound and seconds. Sound that runs past the end of the file ends there."""
    head = f.bytes(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, form, data = 12, None, None
    while data is None and at + 8 <= f.length:
        name, size = struct.unpack("<4sI", f.bytes(at, 8))
        if name == b"fmt ":
            form = f.bytes(at + 8, min(size, 40))
        elif name == b"data":
            data = min(size, f.length - at - 8)
        at += 8 + size + size % 2
    if form is None or len(form) < 16:
        return None
    _, channels, rate, per_second, _, bits = struct.unpack("<HHIIHH", form[:16])
    return {"format": "wav", "rate": rate, "channels": channels, "bits": bits, "bytes": data or 0, "seconds": (data or 0) / per_second if per_second else 0.0}


def zip_entries(f: _Seeker) -> list[str] | None:
    """Names in a zip file, from the directory at its end; None if there is none. Only the directory is read."""
    tail = f.bytes(max(0, f.length - 65_557), 65_557)  # the last record may have a comment of 64 KB behind it
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) < at + 22:
        return None
    size, start = struct.unpack("<II", tail[at + 12 : at + 20])
    wide = tail.rfind(b"PK\x06\x06", 0, at)
    if (size == 0xFFFFFFFF or start == 0xFFFFFFFF) and wide >= 0:
        size, start = struct.unpack("<QQ", tail[wide + 40 : wide + 56])
    table, names, p = f.bytes(start, size), [], 0
    while table[p : p + 4] == b"PK\x01\x02" and len(table) >= p + 46:
        name, extra, note = struct.unpack("<HHH", table[p + 28 : p + 34])
        names.append(table[p + 46 : p + 46 + name].decode("utf-8", "replace"))
        p += 46 + name + extra + note
    return names


def described(path: str, length: int, where: afs.FileSystem, local: str) -> tuple:
    f = _Seeker(where, local, length)
    info = wav_header(f)
    entries = zip_entries(f) if info is None else None
    info = info or {"format": "zip" if entries is not None else "other"}
    return (path, length, info["format"], info.get("rate"), info.get("channels"), info.get("bits"), info.get("bytes"), info.get("seconds"), entries, f.read)


@dataclass
class _Files(InputPartition):
    files: list = field(default_factory=list)


class _HeaderReader(DataSourceReader):
    def __init__(self, path: str, parts: int):
        self.path, self.parts = path, parts

    def partitions(self):
        where, local = _open(self.path)
        found = sorted((x.path, x.size) for x in where.get_file_info(afs.FileSelector(local, recursive=True)) if x.is_file)
        return [_Files(found[i :: self.parts]) for i in range(min(self.parts, len(found)))] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        where, _ = _open(self.path)
        for path, size in partition.files:
            yield described(path, size, where, path)


class ClipHeaders(DataSource):
    """Format `clip_headers`: one row a file under `path`, what its header tells, and the bytes read for that. Options: path, partitions (64)."""

    @classmethod
    def name(cls):
        return "clip_headers"

    def schema(self):
        return HEADERS

    def reader(self, schema):
        return _HeaderReader(self.options["path"], int(self.options.get("partitions", 64)))


@dataclass
class _Wrote(WriterCommitMessage):
    files: dict


def _wav(samples: list[float] | None, rate: int | None) -> bytes:
    held = np.nan_to_num(np.asarray(samples or [], float))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(int(rate or 24000))
        w.writeframes((np.clip(held, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


class _ClipWriter(DataSourceWriter):
    """Tasks write files under names that no other attempt uses; the commit writes one list of them. What no list names is not there for readers."""

    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, iterator) -> _Wrote:
        where, local = _open(self.path)
        context, files = TaskContext.get(), {}
        folder = f"{local}/data/{self.run}"
        where.create_dir(folder, recursive=True)
        made = []
        try:
            for row in iterator:
                name = f"{context.partitionId()}-{context.taskAttemptId()}-{len(made)}.wav"
                made.append(f"{folder}/{name}")
                with where.open_output_stream(made[-1]) as f:
                    f.write(_wav(row["samples"], row["rate"]))
                files[row["name"]] = f"data/{self.run}/{name}"
        except BaseException:
            for f in made:
                where.delete_file(f)
            raise
        return _Wrote(files)

    def commit(self, messages) -> None:
        where, local = _open(self.path)
        files = {k: v for m in messages if m is not None for k, v in m.files.items()}
        taken = [x.base_name for x in where.get_file_info(afs.FileSelector(f"{local}/lists", allow_not_found=True))]
        where.create_dir(f"{local}/lists", recursive=True)
        with where.open_output_stream(f"{local}/lists/{len(taken):08d}-{self.run}.json") as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        where, local = _open(self.path)
        folder = f"{local}/data/{self.run}"
        if where.get_file_info(folder).type == afs.FileType.Directory:
            where.delete_dir(folder)


class ClipSink(DataSource):
    """Format `clips`: writes (name, samples, rate) as WAV files under the option path. A job adds all its clips or none; a later job's clip takes the place of an earlier one of its name."""

    @classmethod
    def name(cls):
        return "clips"

    def schema(self):
        return CLIPS

    def writer(self, schema, overwrite):
        return _ClipWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ClipHeaders)
    spark.dataSource.register(ClipSink)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(name, file) of the clips that committed jobs have written, the last of each name."""
    lists = spark.read.option("wholetext", True).text(f"{path}/lists").select(F.col("_metadata.file_name").alias("list"), F.explode(F.from_json("value", "map<string,string>")).alias("name", "file"))
    return lists.groupBy("name").agg(F.max_by("file", "list").alias("file"))


def sweep(path: str) -> int:
    """Removes the files of jobs that never committed, such as those of tasks that ended after their job was given up; how many folders went. Not while a job writes."""
    where, local = _open(path)
    runs = [x for x in where.get_file_info(afs.FileSelector(f"{local}/data", allow_not_found=True)) if x.type == afs.FileType.Directory]
    listed = {x.base_name.split("-")[1].removesuffix(".json") for x in where.get_file_info(afs.FileSelector(f"{local}/lists", allow_not_found=True))}
    gone = [x.path for x in runs if x.base_name not in listed]
    for folder in gone:
        where.delete_dir(folder)
    return len(gone)


def model_verdict(entries, name, length):
    """What a model file is: `checkpoint` or `model` by what its archive holds; where it is no archive, by its name and size."""
    says = lambda *words: F.exists(entries, lambda e: F.lower(e).rlike("|".join(words)))
    by_name = F.when(F.lower(name).rlike(r"^[gd]_\d+\.pth$|checkpoint|pretrain") | (length >= 150 << 20), "checkpoint").when(length >= 5 << 20, "maybe").otherwise("unknown")
    return F.when(entries.isNull(), by_name).when(says(r"(^|/)data\.pkl$") & says("optimizer", "learning_rate", "iteration"), "checkpoint").when(says(r"(^|/)data\.pkl$"), "model").otherwise("archive")
