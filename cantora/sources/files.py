"""Sources and sinks: manuscripts, lexicons, ledgers, pair lists, WAV clips; chunk files and JSON lines."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEXICON = "abbreviations map<string,string>, words map<string,string>, numbers map<string,string>, repetition_bases array<string>"


def manuscripts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole UTF-8 files; empty ones are left out."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(F.trim("text") != "")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """kind, term, spoken of a JSON lexicon; fields of the wrong type are null and give no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", LEXICON).alias("x"))
    parts = [raw.select(F.lit(k).alias("kind"), F.explode(f"x.{k}").alias("term", "spoken")) for k in ("abbreviations", "words", "numbers")]
    parts.append(raw.select(F.lit("repetition_bases").alias("kind"), F.explode("x.repetition_bases").alias("term"), F.lit(None).cast("string").alias("spoken")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def learn(known: DataFrame, added: DataFrame) -> DataFrame:
    """Lexicon rows with a user's terms over the built-in ones."""
    return added.unionByName(known.join(added.select("kind", "term"), ["kind", "term"], "left_anti"))


def save_lexicon(rules: DataFrame, path: str) -> None:
    """Lexicon rows (kind, term, spoken) as one JSON line that lexicon() reads: one row, as a dictionary is."""
    pairs = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("term", "spoken"))))).alias(k)
    bases = F.array_sort(F.collect_list(F.when(F.col("kind") == "repetition_bases", F.col("term")))).alias("repetition_bases")
    rules.dropDuplicates(["kind", "term"]).agg(*[pairs(k) for k in ("abbreviations", "words", "numbers")], bases).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A JSON object over its defaults, key by key: a value of the file replaces a default whole. Without a file the defaults are written there."""
    import json

    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        held = spark.read.text(path, wholetext=True).collect()  # one small file
    except (AnalysisException, Py4JJavaError):
        spark.createDataFrame([(json.dumps(defaults, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
        return dict(defaults)
    return defaults | json.loads("".join(r["value"] for r in held))


def json_field(c, path: str, default):
    """A field of a JSON text, with a default where it is missing or null."""
    kind = {int: "long", float: "double", str: "string", bool: "boolean"}[type(default)]
    return F.coalesce(F.get_json_object(c, path).try_cast(kind), F.lit(default))


def with_defaults(c, defaults: dict):
    """A JSON object text with a default for each key that it lacks; fields of other names stay."""
    held = F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    base = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(str(v)))])
    missing = F.map_filter(base, lambda k, v: ~F.map_contains_key(held, k))
    return F.to_json(F.map_concat(held, missing))


def ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt lines) of a ledger of JSON lines."""
    shape = "cid string, tts string, rvc string, validation string, attempts int, engine string, error string, _bad string"
    got = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", shape, {"columnNameOfCorruptRecord": "_bad"}).alias("x")).select("x.*")
    return got.filter("_bad IS NULL").drop("_bad"), got.filter("_bad IS NOT NULL").select("_bad")


def restart(spark: SparkSession, path: str, aside: str) -> DataFrame:
    """A ledger's readable rows; lines that cannot be read are set aside as text, for a human."""
    good, bad = ledger(spark, path)
    if not bad.isEmpty():
        bad.withColumnRenamed("_bad", "value").write.mode("append").text(aside)
    return good


def save_ledger(rows: DataFrame, path: str) -> None:
    """The ledger as JSON lines in a new folder beside the old one; Spark's commit shows it only when whole."""
    rows.withColumn("updated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def pair_table(spark: SparkSession, path: str, tab: bool = True) -> DataFrame:
    """stem, text of lines `name<tab>text`, or of CSV lines; later fields belong to the text; lines with one field are left out."""
    if not tab:
        rows = spark.read.option("header", "false").option("escape", '"').csv(path, schema="a string, b string, c string, d string, e string, f string, g string, h string")
        return rows.filter("b IS NOT NULL").select(F.trim("a").alias("stem"), F.trim(F.concat_ws(",", *"bcdefgh")).alias("text"))
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).filter(F.size(parts) == 2).select(F.trim(parts[0]).alias("stem"), F.trim(parts[1]).alias("text"))


def folder_pairs(spark: SparkSession, path: str, kinds: tuple = (".wav", ".mp3", ".m4a", ".flac", ".ogg")) -> DataFrame:
    """path, stem, text of clips with a text file of the same name beside them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    clips = found.withColumn("_base", F.regexp_replace("path", r"\.[^./]+$", "")).filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*kinds))
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), r"\.[^./]+$", "").alias("_key"), F.trim("value").alias("text"))
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    return clips.join(texts, plain(F.col("_base")) == plain(F.col("_key"))).select("path", F.element_at(F.split("_base", "/"), -1).alias("stem"), "text")


def pair_index(spark: SparkSession, path: str) -> DataFrame:
    """stem, text of lines `name|text`; later pipes belong to the text."""
    parts = F.split("value", r"\|", 2)
    return spark.read.text(path).filter(F.col("value").contains("|")).select(F.trim(parts[0]).alias("stem"), F.trim(parts[1]).alias("text"))


def _samples(data: bytes):
    try:
        with wave.open(io.BytesIO(data)) as w:
            n, width, channels, rate = w.getnframes(), w.getsampwidth(), w.getnchannels(), w.getframerate()
            raw = w.readframes(n)
    except (wave.Error, EOFError):
        return None, None, None
    kind = {1: np.uint8, 2: "<i2", 4: "<i4"}.get(width)
    if kind is None:
        return rate, channels, None
    x = np.frombuffer(raw, kind).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return rate, channels, x.reshape(-1, channels).mean(1).tolist()


def clips(spark: SparkSession, path: str) -> DataFrame:
    """path, sr, channels, samples of WAV files (PCM of 8, 16 or 32 bits, channels averaged); nulls where a file can't be read."""

    def read(batches):
        for batch in batches:
            got = [_samples(bytes(x)) for x in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "sr": pd.array([g[0] for g in got], "Int32"), "channels": pd.array([g[1] for g in got], "Int32"), "samples": [g[2] for g in got]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content").mapInPandas(read, "path string, sr int, channels int, samples array<double>")


def write_chunks(chunks: DataFrame, path: str, add: bool = False) -> None:
    """One folder a chapter, lines of text. The commit protocol writes aside and renames; add: only chapters that are not there yet are written, so a run that is repeated adds nothing."""
    rows = chunks.select("chapter", "text")
    if add:
        from pyspark.errors import AnalysisException

        try:
            there = rows.sparkSession.read.text(path).select(F.col("chapter").cast("string").alias("_c")).distinct()
            rows = rows.join(there, rows["chapter"].cast("string") == there["_c"], "left_anti")
        except AnalysisException:
            pass  # nothing written yet
    rows.write.mode("append" if add else "overwrite").partitionBy("chapter").text(path)


def changes_report(chapters: DataFrame, counters: list[str]) -> DataFrame:
    """One line a chapter for a report: its sizes, and the rules that did something. chapters: chapter, title, before, after, sentences, chunks, counters."""
    label = F.concat(F.lit("chapter "), F.col("chapter").cast("string"), F.when(F.col("title") != "", F.concat(F.lit(" — "), F.col("title"))).otherwise(""))
    used = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.lit(f"{c} x"), F.col(c).cast("string"))) for c in counters]))
    rules = F.when(F.size(used) > 0, F.array_join(used, ", ")).otherwise("none needed")
    return chapters.select("chapter", F.concat(label, F.format_string(": %d chars -> %d chars, %d sentences, %d chunks\n    rules: ", "before", "after", "sentences", "chunks"), rules).alias("line"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select("audio", "text").write.mode("overwrite").json(path)


def pairs_report(kept: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: clips kept and skipped, minutes, mean seconds, and why clips were left out (the first 40). kept: seconds; skipped: label, reason."""
    why = skipped.groupBy().agg(F.count(F.lit(1)).alias("skipped"), F.slice(F.array_sort(F.collect_set(F.concat_ws(": ", "label", "reason"))), 1, 40).alias("why"))
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.bround(F.sum("seconds") / 60, 1).alias("minutes"), F.bround(F.avg("seconds"), 1).alias("mean_s")).crossJoin(F.broadcast(why))  # one row
