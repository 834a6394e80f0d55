"""Verdicts on measured clips. Every input is a column that may be null (not measured); every output is a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantora.functions import fixed as X
from cantora.functions.numbers import clamp, rounded

from .curate import problems, reason

L = X.CLIP_LINES


def _or(name: str, value: float) -> Column:
    return F.coalesce(F.col(name), F.lit(value))


def score() -> Column:
    """0 to 100 from snr_db, reverb, rumble, mud, presence, sibilance, wander_db and clip_pct; 100 needs nothing. What is not measured costs nothing."""
    snr = _or("snr_db", 60.0)
    costs = [  # by how much a measure is over its line, the points each unit costs, the most it costs
        (45 - snr, 0.9, 22.0), (F.when(snr > 45, F.col("reverb")) - 0.025, 300, 18.0), (F.col("rumble") - L["rumble"], 40, 10.0), (F.col("mud") - L["mud"], 3, 10.0),
        (L["presence"] - F.col("presence"), 400, 10.0), (F.col("sibilance") - L["sibilance"], 6.0, 8.0), (F.col("wander_db") - L["wander"], 1.5, 8.0),
    ]
    lost = [F.when(over > 0, F.least(F.lit(most), over * each)).otherwise(0.0) for over, each, most in costs]
    lost.append(F.when(F.col("clip_pct") > 0.01, F.least(F.lit(12.0), F.col("clip_pct") * 200)).otherwise(0.0))
    return clamp(rounded(reduce(lambda s, x: s - x, lost, F.lit(100.0))), 0.0, 100.0).cast("int")


def band(points: Column) -> Column:
    return F.coalesce(*[F.when(points < below, name) for below, name in X.SCORE_BANDS], F.lit(X.SCORE_BANDS[-1][1]))


def cleanup(clips: DataFrame, cap: float = 1.0) -> DataFrame:
    """Adds score, band, strength, each stage's settings (null: the stage stays out) and the stages' names in order.

    A clip beyond no line gets no stage. Compression comes from a wandering level or, lightly, from a strength over 0.25.
    """
    snr, st = _or("snr_db", 60.0), F.col("_st")
    grow = 0.6 + 0.4 * st
    c = clips.withColumn("score", score())
    c = c.withColumn("band", band(F.col("score"))).withColumn("_st", clamp((100 - F.col("score")) / 100.0 * cap, 0.0, 1.0)).withColumn("strength", rounded(st, 3))
    clarity = F.when(F.col("presence") < L["presence"], F.greatest(F.lit(0.25), F.least(F.lit(1.6), 0.5 + (L["presence"] - F.col("presence")) * 40.0) * grow))
    low = F.when(F.col("mud") > L["mud"], F.least(F.lit(2.0), 0.5 + (F.col("mud") - L["mud"]) * 0.35) * grow)
    harsh = F.when(F.col("sibilance") > L["sibilance"], F.least(F.lit(3.0), 0.8 + (F.col("sibilance") - L["sibilance"]) * 1.2) * grow)
    wander, light = F.col("wander_db") > L["wander"], st > 0.25
    speech = _or("speech_db", -22.0)
    c = c.withColumns({
        "denoise": F.when(snr < 42.0, rounded(F.least(F.lit(20.0), 6.0 + 14.0 * F.least(F.lit(1.0), (42.0 - snr) / 22.0) * grow), 1)),
        "noise_gate": F.when(snr < 42.0, rounded(clamp(_or("noise_db", -50.0), -60.0, -30.0), 1)),
        "dereverb": F.when(F.col("reverb") > 0.02, rounded(F.greatest(F.lit(0.1), F.least(F.lit(0.5), 0.2 + (F.col("reverb") - 0.02) * 7.0) * grow), 3)),
        "highpass": F.when(F.col("rumble") > L["rumble"], F.when(st < 0.5, 70).when(st < 0.8, 80).otherwise(90)),
        "low_mid": rounded(-low, 2), "clarity": rounded(clarity, 2), "deess": rounded(harsh, 2),
        "ratio": F.when(wander, rounded(2.0 + F.least(F.lit(1.0), (F.col("wander_db") - L["wander"]) / 8.0), 1)).when(light, rounded(2.0 + F.least(F.lit(1.0), st), 1)),
        "threshold": F.when(wander, rounded(clamp(speech - 4.0, -40.0, -12.0), 1)).when(light, rounded(clamp(speech - 3.0, -40.0, -12.0), 1)),
    })
    named = [("denoise", "noise reduction"), ("dereverb", "de-reverb"), ("highpass", "rumble filter"), ("low_mid", "low-mid"), ("clarity", "presence"), ("deess", "harshness"), ("ratio", "gentle compression")]
    return c.withColumn("stages", F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), name) for k, name in named]))).drop("_st")


def changes(before: DataFrame, after: DataFrame, key: list[str], redo_cap: float = 0.4, cap: float = 1.0) -> DataFrame:
    """What a pass made worse, by key, and the next step: done, redo (once, with a lower cap) or keep."""
    names = ["sibilance", "rumble", "snr_db", "noise_db", "presence"]
    a, b = (df.select(*key, *[F.col(n).alias(f"{p}_{n}") for n in names]) for df, p in ((before, "a"), (after, "b")))
    worse = problems(
        (_or("b_sibilance", 0.0) > F.greatest(F.lit(L["sibilance"]), _or("a_sibilance", 0.0) * 1.35), "added harshness"),
        (_or("b_rumble", 0.0) > _or("a_rumble", 0.0) * 1.5 + 0.01, "added low rumble"),
        ((_or("b_snr_db", 99.0) < _or("a_snr_db", 0.0) - 3) & (_or("b_noise_db", -120.0) > -70.0), "made the noise floor worse"),
        (_or("b_presence", 1.0) < _or("a_presence", 1.0) * 0.6, "lost clarity"),
    )
    step = F.when(F.size("worse") == 0, "done").otherwise("redo" if cap > redo_cap + 1e-6 else "keep")
    return a.join(b, key).select(*key, worse.alias("worse")).withColumn("step", step)


def flag(clipped_pct: Column, floor_db: Column, seconds: Column) -> Column:
    """The first thing that makes a training clip a poor one; null: nothing."""
    return reason((clipped_pct > 0.5, "clipping"), (floor_db > -38, "noisy"), (seconds < 2.0, "too short"))


def clip_problems(rate: Column, channels: Column, seconds: Column, peak: Column, rms: Column, least: float = 0.2) -> Column:
    """Format problems of a clip; only a clip without them is judged by its level."""
    form = problems((rate < 8000, "implausible sample rate"), (~channels.isin(1, 2), "unexpected channel count"), (seconds <= 0, "zero duration"), ((seconds > 0) & (seconds < least), "too short"))
    return F.when(F.size(form) > 0, form).otherwise(problems((peak > 0.999, "clipping"), (rms < 0.002, "silent")))


def least_seconds(text: Column) -> Column:
    """The shortest time in which a text can be spoken."""
    words = F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))
    return F.coalesce(F.greatest(F.lit(0.4), 0.22 * words, 0.03 * F.length(text)), F.lit(0.4))


def complete(text: Column, estimate: Column, measured: Column) -> Column:
    """Whether a reading is whole: clear cases by the estimate, the others by the measured time."""
    need = least_seconds(text)
    return F.when(estimate >= need * 1.25, True).when(estimate < need * 0.6, False).otherwise(measured >= need)


def pitch_range(hz: Column) -> Column:
    return F.when(F.coalesce(hz, F.lit(0.0)) == 0, "unmeasured").when(hz < 155, "male range").when(hz < 165, "low / androgynous range").otherwise("female range")


def reasons() -> Column:
    """Why a cleanup plan has its stages, in their order, from the measures that cleanup() reads."""
    snr, said = _or("snr_db", 60.0), F.format_string
    return F.array_compact(F.array(
        F.when(snr < 42.0, said("noise floor %.0f dB, SNR %.0f dB", _or("noise_db", -120.0), snr)),
        F.when(F.col("reverb") > 0.02, said("ringing after the words (%.3f of speech energy)", "reverb")).when(F.col("reverb").isNull(), "reverb not measurable (no quiet gaps)"),
        F.when(F.col("rumble") > L["rumble"], said("low rumble %.3f", "rumble")), F.when(F.col("mud") > L["mud"], said("low-mid weight high (%.2f)", "mud")), F.when(F.col("presence") < L["presence"], said("clarity low (%.4f)", "presence")),
        F.when(F.col("sibilance") > L["sibilance"], said("top end %.2f× its own body (voice range 0.28–0.98)", "sibilance")), F.when(F.col("wander_db") > L["wander"], said("phrase level wanders %.1f dB (healthy voices ≤ 9.3)", "wander_db")),
    ))


def second_pass(clips: DataFrame, first: DataFrame, key: list[str], redo_cap: float = 0.4) -> DataFrame:
    """cleanup() of the clips whose first pass (changes()) says redo, once more from the original with a lower cap; the others' plans stay."""
    again = first.filter("step = 'redo'").select(*key)
    light = cleanup(clips.join(again, key, "left_semi"), redo_cap).withColumn("redone", F.lit(True))
    return light.unionByName(cleanup(clips.join(again, key, "left_anti")).withColumn("redone", F.lit(False)))


def cleanup_gate(cloned: Column, text: Column, state: Column) -> Column:
    """What a finished job is told about its cleanup; null: it ran."""
    from cantora.functions.text import KHMER, is_script

    return F.when(~cloned, "HD Cleanup belongs to the RVC VOICE CLONE — skipped on this job.").when(~is_script(text, KHMER), "HD Cleanup is Khmer only — skipped.").when(state != "done", "Enhancement unavailable; original TTS preserved.")
