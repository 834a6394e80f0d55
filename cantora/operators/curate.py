"""Training pairs: joins of audio and text by stem, gates with reasons, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_match(texts: DataFrame, files: DataFrame, key: str, kind: str, priority: list[str]) -> DataFrame:
    """Inner join on key that keeps, of a key's files, the one whose kind comes first in priority."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(kind))
    best = files.withColumn("_p", rank).filter("_p > 0").withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("_p"))).filter("_r = 1").drop("_p", "_r")
    return texts.join(best, key)


def reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return F.coalesce(*[F.when(c, name) for c, name in rules])


def problems(*rules: tuple[Column, str]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, name) for c, name in rules]))


def verdict(minutes: Column) -> Column:
    return F.when(minutes >= 30, "excellent").when(minutes >= 10, "good").when(minutes >= 5, "usable").otherwise("too little")


#: Reasons against a training pair, the first that holds, and its limits in seconds and level.
SHORTEST_S, LONGEST_S, SILENT = 1.0, 20.0, 0.002


def pair_reason(text: Column, converted: Column, seconds: Column, rms: Column) -> Column:
    """Why a pair of text and clip is left out; null: it stays. seconds is null for a clip that cannot be read."""
    return reason(
        (~F.coalesce(text.rlike("[ក-៿]"), F.lit(False)), "no Khmer script in the text"), (F.length(text) < 2, "text too short"), (~converted, "could not convert audio"), (seconds.isNull(), "unreadable wav"),
        (seconds < SHORTEST_S, "too short"), (seconds > LONGEST_S, "too long"), (rms < SILENT, "almost silent"),
    )


def listed(rows: DataFrame, shelf: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each shelf, as a report lists them, with how many more there are."""
    w = W.partitionBy(shelf).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r").join(rows.groupBy(shelf).agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).cast("long").alias("more")), shelf)


#: Sizes of voice models and training checkpoints, and names of the latter.
MODEL_BYTES, CHECKPOINT_BYTES = 5 << 20, 150 << 20


def checkpoint_name(name: Column) -> Column:
    return F.upper(F.substring(name, 1, 2)).isin("G_", "D_") | F.lower(name).rlike("train|checkpoint")


def model_verdict(name: Column, size: Column) -> Column:
    """What a model file is, by its name and size."""
    return F.when(checkpoint_name(name) | (size >= CHECKPOINT_BYTES), "checkpoint").when(size >= MODEL_BYTES, "maybe").otherwise("unknown")


def training_run(log: Column) -> Column:
    """What a training log says: sample rate label, epochs set, version, pitch guidance, last epoch seen, whether it ended. The last mention counts."""
    last = lambda p: F.element_at(F.nullif(F.regexp_extract_all(log, F.lit(p), F.lit(1)), F.array().cast("array<string>")), -1)
    sr, seen = last(r"-sr\s+(\d+)"), F.regexp_extract_all(log, F.lit(r"(?i)epoch\s*[:=]?\s*(\d+)"), F.lit(1))
    label = F.when(sr.isNull(), "?").when(sr.startswith("48"), "48k").when(sr.startswith("40"), "40k").when(sr.startswith("32"), "32k").otherwise(sr)
    ended = F.lower(log).contains("all processes have been completed") | F.lower(log).contains("training complete")
    return F.struct(label.alias("sr"), last(r"-te\s+(\d+)").cast("int").alias("epochs"), F.coalesce(last(r"-v\s+(v\d)"), F.lit("?")).alias("version"), F.coalesce(last(r"-f0\s+(\d)"), F.lit("?")).alias("f0"), F.array_max(F.transform(seen, lambda x: x.cast("int"))).alias("seen"), ended.alias("completed"))


def rate_moved(text: Column) -> Column:
    """Percent by which a text like `226.4 → 227.5 Hz` says a value moved; null if it does not."""
    a, b = (F.try_to_number(F.nullif(F.regexp_extract(text, r"^\s*([\d.]+)\s*→\s*([\d.]+)", k), F.lit("")), F.lit("99999D99999")).cast("double") for k in (1, 2))
    return F.abs(b - a) / F.nullif(a, F.lit(0.0)) * 100


def matrix_summary(samples: DataFrame) -> DataFrame:
    """Of samples (id, damage, stages, f0, ltas): clean and damaged ones, clean ones that nothing was done to, the distinct stages done to clean ones, and the largest moves."""
    clean = F.coalesce(F.col("damage") == "", F.lit(True))
    idle = (F.size("stages") == 0) | ((F.size("stages") == 1) & F.lower(F.get("stages", F.lit(0))).contains("nothing"))
    moves = F.when(clean & ~idle, F.transform("stages", lambda x: F.trim(F.substring_index(x, "@", 1)))).otherwise(F.array().cast("array<string>"))
    rows = samples.withColumn("_moved", rate_moved(F.col("f0")))
    best = lambda k: F.max_by("id", F.when(k, F.struct("ltas", -F.col("id"))))
    return rows.agg(
        F.count_if(clean).alias("clean"), F.count_if(~clean).alias("damaged"), F.count_if(clean & idle).alias("untouched"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(moves)))).alias("moves"),
        F.max(F.when(clean, F.col("_moved"))).alias("clean_f0"), F.max(F.when(~clean, F.col("_moved"))).alias("damaged_f0"), best(clean).alias("clean_most"), best(~clean).alias("damaged_most"),
    )


def joined_parts(rows: DataFrame, key: str, order: list[str], part: str) -> DataFrame:
    """Each key's arrays one after another."""
    return rows.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, part))), lambda x: x[part])).alias(part))


def merged_settings(given: Column, defaults: dict, limits: dict, choices: dict) -> Column:
    """A struct of settings: the given ones (a map of texts) over their defaults; numbers are held in their limits and rounded, names must be one of their choices, texts are cut at 400 characters."""
    own = lambda k: F.try_element_at(given, F.lit(k))

    def one(k, default):
        if k in limits:
            lo, hi = limits[k]
            number = F.coalesce(own(k).try_cast("double"), F.lit(float(default)))
            return F.bround(F.greatest(F.lit(lo), F.least(F.lit(hi), number)), 3)
        if k in choices:
            return F.when(own(k).isin(*choices[k]), own(k)).otherwise(default)
        return F.coalesce(F.substring(F.trim(own(k)), 1, 400), F.lit(default))

    return F.struct(*[one(k, v).alias(k) for k, v in defaults.items()])


def once_each(rows: DataFrame, text: str, make, name: str = "made") -> DataFrame:
    """rows with make(text) as a column, worked out once for each distinct text and joined back; a null text gives null."""
    done = rows.select(F.col(text).alias("_t")).filter("_t IS NOT NULL").distinct().withColumn("_made", make(F.col("_t"))).withColumn("_k", F.xxhash64("_t"))
    keyed = rows.withColumn("_k2", F.xxhash64(text))
    return keyed.join(done, (F.col("_k") == F.col("_k2")) & (F.col(text) == F.col("_t")), "left").withColumn(name, F.col("_made")).drop("_t", "_made", "_k", "_k2")
