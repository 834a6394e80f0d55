"""The engine's services as functions of a session, a table and parameters, each giving a table."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantora.functions import fixed as X
from cantora.functions import frontend, text
from cantora.operators import quality
from cantora.plans import dialogue, expressive, performance
from cantora.sources import files


def prepare(spark: SparkSession, docs: DataFrame, params: dict | None = None) -> DataFrame:
    """docs with `prepared`: spoken and phrased text, counters, notes, pause marks. params: text (column), lexicon."""
    p = params or {}
    return docs.withColumn("prepared", frontend.prepared(F.col(p.get("text", "text")), p.get("lexicon")))


def learn(spark: SparkSession, rules: DataFrame, params: dict) -> DataFrame:
    """The lexicon with one more rule (term, spoken, kind: words, abbreviations, numbers, repetition_bases); blank terms add nothing, and a reading is needed but for a repetition."""
    term, spoken, kind = (str(params.get(k) or "").strip() for k in ("term", "spoken", "kind"))
    if not term or not spoken:
        return rules
    kind = kind if kind in ("words", "abbreviations", "numbers", "repetition_bases") else "words"
    own = spark.createDataFrame([(kind, term, None if kind == "repetition_bases" else spoken)], "kind string, term string, spoken string")
    return files.learn(rules, own)


def perform(spark: SparkSession, docs: DataFrame, params: dict | None = None) -> DataFrame:
    """The expressive plan's units. params: key, text, style (any name of it), intensity, speed, pause, lexicon."""
    p = {"key": "doc_id", "text": "text", "style": "natural", **(params or {})}
    options = {k: p[k] for k in ("intensity", "speed", "pause", "lexicon") if k in p}
    return expressive.units(docs, p["key"], style_id(p["style"]), p["text"], **options)


def plan(spark: SparkSession, docs: DataFrame, params: dict | None = None) -> DataFrame:
    """The performance plan with its timeline. params: styles, pause, speed, voice_pitch."""
    p = params or {}
    options = {k: p[k] for k in ("pause", "speed", "voice_pitch") if k in p}
    return performance.timeline(performance.plan(docs, only=[style_id(s) for s in p.get("styles", ["natural"])], **options), pause=p.get("pause", 0.35))


def script(spark: SparkSession, docs: DataFrame, params: dict | None = None) -> DataFrame:
    """Two hosts' conversation about each text, in the language asked for or told by its script. params: key, lang."""
    p = {"key": "doc_id", **(params or {})}
    spoken = docs.withColumn("_lang", text.route(F.col("text"), F.lit(p.get("lang")).cast("string")))
    own = lambda lang: spoken.filter(F.col("_lang") == lang).drop("_lang")
    rows = dialogue.hosts(own("en"), p["key"])
    for lang in X.PARAGRAPH_HOSTS:
        rows = rows.unionByName(dialogue.paragraph_hosts(own(lang), p["key"], lang))
    return rows


def emotions(spark: SparkSession, docs: DataFrame | None = None, params: dict | None = None) -> DataFrame:
    return expressive.families(spark)


def styles(spark: SparkSession, docs: DataFrame | None = None, params: dict | None = None) -> DataFrame:
    return performance.style_table(spark)


def style_id(name: str) -> str:
    """A style's id from any name of it; natural for others."""
    plain = str(name or "").strip().lower()
    known = {s[0]: s[0] for s in X.STYLES} | X.STYLE_ALIASES
    return known.get(plain) or known.get(plain.replace("-", "_")) or "natural"


def speak(units: DataFrame, key: str, engines: dict[str, Callable[[str, str], bytes]], seconds: Callable[[bytes], float], order: list[str] | None = None, rate: str = "+0%") -> DataFrame:
    """key, ok, engine, audio, tried of each unit's text: the first engine in order whose reading is whole. An engine takes (text, rate) and gives sound or raises; seconds tells how long a sound is.

    Engines run in the tasks, so they must be safe to call again when a task is run again.
    """
    names = [e for e in (order or X.ENGINE_ORDER) if e in engines]

    def one(t: str, need: float) -> tuple[bool, str | None, bytes | None, list[str]]:
        tried: list[str] = []
        for name in names if t.strip() else []:
            try:
                sound = engines[name](t, rate)
                if sound and seconds(sound) >= need:
                    return True, name, sound, tried
                tried.append(f"{name}: truncated audio")
            except Exception as e:  # an engine that fails hands over to the next
                tried.append(f"{name}: {type(e).__name__}")
        return False, None, None, tried

    def run(batches):
        for batch in batches:
            got = [one(t or "", need) for t, need in zip(batch.column("text").to_pylist(), batch.column("need").to_pylist(), strict=True)]
            ok, engine, audio, tried = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(ok, pa.bool_()), pa.array(engine, pa.string()), pa.array(audio, pa.binary()), pa.array(tried, pa.list_(pa.string()))], names=[key, "ok", "engine", "audio", "tried"])

    kind = units.schema[key].dataType.simpleString()
    return units.select(key, "text", quality.least_seconds(F.col("text")).alias("need")).mapInArrow(run, f"{key} {kind}, ok boolean, engine string, audio binary, tried array<string>")
