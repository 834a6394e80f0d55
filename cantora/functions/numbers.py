"""Number expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def rounded(x: Column, places: int = 0) -> Column:
    """Half to even, on the scaled number."""
    return F.rint(x * 10.0**places) / 10.0**places


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def semitone_hz(st: Column, base: float = 150.0) -> Column:
    """Hertz by which a shift of so many semitones moves the base."""
    return rounded(base * (F.pow(F.lit(2.0), st / 12.0) - 1.0)).cast("int")


def soft(x: Column, cap: float) -> Column:
    return cap * F.tanh(x / cap)


def guarded(pitch: Column, gain: Column, pace: Column) -> list[Column]:
    """Pitch and gain bent softly under their caps, pace held in its band."""
    return [rounded(soft(pitch, X.IDENTITY["pitch"]), 3).alias("pitch"), rounded(soft(gain, X.IDENTITY["gain"]), 2).alias("gain"), rounded(clamp(pace, *X.IDENTITY["pace"]), 4).alias("pace")]
