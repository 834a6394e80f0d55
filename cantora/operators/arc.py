"""The gain arc of spoken sentences: each builds to its loudest quarter second and eases away. Frames are rows; clips of any length are spread over tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantora.functions.fixed import EXPRESSIVE, EXPRESSIVE_BOUNDS, PRESENCE_BAND

#: Frames of a block, the unit in which clips are dealt out.
BLOCK = 4096


def styles(spark: SparkSession) -> DataFrame:
    """The expressive styles that are switched on, within bounds: one row a style."""
    names = ("swell", "beat_db", "ease", "presence", "presence_floor")
    rows = [(k, *(min(hi, max(lo, x)) for x, (lo, hi) in zip(v, EXPRESSIVE_BOUNDS, strict=False)), *v[5:8]) for k, v in EXPRESSIVE.items() if v[8]]
    return spark.createDataFrame(rows, "style string, " + ", ".join(f"{n} double" for n in names) + ", ease_s double, step double, least_words int")


def in_ranges(points: DataFrame, ranges: DataFrame, key: str, at: str, lo: str, hi: str, block: int = BLOCK) -> DataFrame:
    """Points with the columns of each range [lo, hi) of their key that holds them.

    Ranges are laid over blocks of places and points join their own block, so that a key with most points is dealt out too,
    and a pair is tried only if range and point share a block.
    """
    over = ranges.filter(F.col(hi) > F.col(lo)).withColumn("_block", F.explode(F.sequence(F.floor(F.col(lo) / block), F.floor((F.col(hi) - 1) / block))))
    own = points.withColumn("_block", F.floor(F.col(at) / block))
    return own.join(over, [key, "_block"]).filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_block")


def moving_sum(frames: DataFrame, key: str, at: str, x: str, before: int, after: int, to: str, block: int = BLOCK) -> DataFrame:
    """Sum of x over the places from `before` back to `after` ahead of each row, where a row is; a key's blocks are summed apart, each with its neighbours' edges."""
    wide = frames.withColumn("_block", F.floor(F.col(at) / block))
    sent = F.array_distinct(F.array(F.col("_block"), F.floor((F.col(at) - after) / block), F.floor((F.col(at) + before) / block)))
    held = wide.withColumn("_in", F.explode(sent))
    w = W.partitionBy(key, "_in").orderBy(at).rangeBetween(-before, after)
    return held.withColumn(to, F.sum(x).over(w)).filter(F.col("_in") == F.col("_block")).drop("_in", "_block")


def _line(a: Column, b: Column, i: Column, n: Column) -> Column:
    """The i-th of n even steps from a to b; a if there is but one."""
    return F.when(n > 1, a + (b - a) * i / (n - 1)).otherwise(a)


def gain_arcs(frames: DataFrame, sentences: DataFrame, plans: DataFrame, clip: str, at: str, level: str, hop_s: float) -> DataFrame:
    """frames with sentence, style, beat, arc_db, gain_db and presence_db, for frames in sentences.

    sentences: clip, sentence (its index in the clip), lo and hi (frames, hi not included), style, words. Frames `hop_s`
    seconds long hold a level of 0 or more. Within a sentence, what is over 0.08 of its loudest frame counts as voice. The
    beat is the first frame of its loudest 250 ms. The arc rises from -swell at the first voice to the lift at the beat and
    falls to the ease at the last; the last `ease_s` seconds fade from 0; odd sentences lie a step higher than even ones; a
    sentence short of its style's least words moves less. arc_db is smoothed over 90 ms inside the sentence, gain_db over
    sentences' borders too (outside sentences the arc is 0). presence_db swells around the beat.

    A style that is off or unknown, and a sentence with under three frames or three voiced ones, has gain 0 and no beat. Null
    levels are silent; null clips and empty sentences match nothing; an empty table stays empty.
    """
    n = max(1, int(0.09 / hop_s))
    win = max(1, int(0.25 / hop_s))
    j, ws = F.col("_j"), W.partitionBy(clip, "sentence")
    # eight styles at most
    told = sentences.join(F.broadcast(plans), "style", "left").select(F.col(clip), "sentence", "lo", "hi", "style", "words", *plans.drop("style").columns)
    rows = in_ranges(frames.withColumn("_e", F.coalesce(F.col(level).cast("double"), F.lit(0.0))), told, clip, at, "lo", "hi").withColumn("_j", F.col(at) - F.col("lo"))
    order = ws.orderBy(at)
    rows = rows.withColumns({"_top": F.max("_e").over(ws), "_n": F.count(F.lit(1)).over(ws), "_mean": F.avg("_e").over(order.rowsBetween(0, win - 1))})
    voiced = F.when(F.col("_e") > 0.08 * F.col("_top"), j)
    rows = rows.withColumns({"_a": F.min(voiced).over(ws), "_b": F.max(voiced).over(ws), "_voiced": F.count(voiced).over(ws)})
    live = F.col("swell").isNotNull() & (F.col("_n") >= 3) & (F.col("_voiced") >= 3)
    a, b = F.col("_a"), F.col("_b")
    may = live & (j >= a) & (j < F.greatest(a + 1, b - win))
    rows = rows.withColumn("_best", F.max(F.when(may, F.col("_mean"))).over(ws))
    rows = rows.withColumn("beat", F.min(F.when(may & (F.col("_mean") == F.col("_best")), j)).over(ws))
    full, beat = F.col("words") >= F.col("least_words"), F.col("beat")
    swell, lift, ease = F.col("swell") * F.when(full, 1.0).otherwise(0.4), F.col("beat_db") * F.when(full, 1.0).otherwise(0.5), F.col("ease") * F.when(full, 1.0).otherwise(0.5)
    arc = F.when(j >= b, ease).when(j >= beat, _line(lift, ease, j - beat, b - beat)).when(j >= a, _line(-swell, lift, j - a, beat - a)).otherwise(0.0)
    tail = F.greatest(F.lit(1), F.floor(F.col("ease_s") / hop_s))
    fades = (b > tail) & (ease < -0.2) & (j >= b - tail) & (j < b)
    arc = F.when(fades, F.least(arc, _line(F.lit(0.0), ease * 0.85, j - (b - tail), tail))).otherwise(arc)
    step = F.when(F.col("sentence") % 2 == 1, F.col("step")).otherwise(-0.6 * F.col("step"))
    rows = rows.withColumn("_arc", F.when(live, arc + step).otherwise(0.0))
    inside = F.sum("_arc").over(order.rowsBetween(-(n // 2), n - 1 - n // 2)) / n
    rows = rows.withColumn("arc_db", F.when(F.col("_n") > n, inside).otherwise(F.col("_arc")))
    rows = moving_sum(rows, clip, at, "_arc", n // 2, n - 1 - n // 2, "_sum")
    away = (j + 0.5 - beat) * hop_s / 0.28
    presence = F.when(live, F.col("presence_floor") + F.col("presence") * F.exp(-away * away)).otherwise(0.0)
    return rows.select(*frames.columns, "sentence", "style", "beat", "arc_db", (F.col("_sum") / n).alias("gain_db"), presence.alias("presence_db"))


def apply_gain(samples: Column, gain_db: Column, hop: int) -> Column:
    """Samples under a gain that is given every `hop` samples, a line between; brought under 0.98 if that is exceeded."""
    last = F.size(gain_db) - 1

    def db(i):
        k = F.floor(i / hop).cast("int")
        g = F.get(gain_db, F.least(k, last))
        return g + (F.get(gain_db, F.least(k + 1, last)) - g) * (i % hop) / hop

    out = F.transform(samples, lambda x, i: x * F.pow(F.lit(10.0), db(i) / 20.0))
    peak = F.array_max(F.transform(out, lambda x: F.abs(x)))
    # one element, so that the array is worked out once
    return F.when((F.size(samples) > 0) & (F.size(gain_db) > 0), F.transform(F.array(F.struct(out.alias("x"), peak.alias("p"))), lambda s: F.when(s["p"] > 0.98, F.transform(s["x"], lambda x: x * 0.98 / s["p"])).otherwise(s["x"]))[0]).otherwise(samples)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def lifted(samples: pa.Array, rate: pa.Array, beat_s: pa.Array, floor_db: pa.Array, beat_db: pa.Array) -> pa.Array:
    """Samples with the presence band raised by floor_db, and by beat_db more around beat_s; null and empty samples stay."""
    n, out = 1024, []
    win = np.sqrt(np.hanning(n + 1)[:-1])  # squared windows half a window apart add up to one
    for x, sr, at, low, high in zip(samples.to_pylist(), rate.to_pylist(), beat_s.to_pylist(), floor_db.to_pylist(), beat_db.to_pylist(), strict=True):
        if not x or at is None or not (low or high):
            out.append(x)
            continue
        padded = np.pad(np.asarray(x, float), (n // 2, n + n // 2))
        frames = np.lib.stride_tricks.sliding_window_view(padded, n)[:: n // 2] * win
        freq, when = np.fft.rfftfreq(n, 1 / sr), np.arange(len(frames)) * (n // 2) / sr
        band = (freq >= PRESENCE_BAND[0]) & (freq <= PRESENCE_BAND[1])
        gain = 10 ** ((low + high * np.exp(-(((when - at) / 0.28) ** 2))) / 20)
        parts = np.fft.irfft(np.fft.rfft(frames, axis=1) * np.where(band, gain[:, None], 1.0), n, axis=1) * win
        whole = np.zeros(len(padded))
        for k in (0, 1):  # frames of one parity do not overlap
            own = parts[k::2].reshape(-1)
            whole[k * n // 2 : k * n // 2 + len(own)] += own
        out.append(whole[n // 2 : n // 2 + len(x)].tolist())
    return pa.array(out, pa.list_(pa.float64()))
