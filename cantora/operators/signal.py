"""Signal operators on sample arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))


def rms(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(a))


def dbfs(x: Column) -> Column:
    return F.when(x <= 1e-6, F.lit(-120.0)).otherwise(20.0 * F.log10(F.greatest(x, F.lit(1e-6))))


def frames(a: Column, size: int, hop: int) -> Column:
    """Whole frames of `size` samples, `hop` apart."""
    return F.when(F.size(a) >= size, F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - size) / hop).cast("int")), lambda i: F.slice(a, i * hop + 1, F.lit(size)))).otherwise(F.array())


def floor_value(a: Column) -> Column:
    """The value a tenth of the way up the sorted array, without interpolation."""
    return F.element_at(F.array_sort(a), F.floor(F.size(a) * 0.1).cast("int") + 1)


def envelope(samples: DataFrame, key: str, at: str, x: str, n: int) -> DataFrame:
    """Trailing RMS over n samples; early ones are divided by n as well."""
    w = W.partitionBy(key).orderBy(at).rowsBetween(-(n - 1), 0)
    return samples.withColumn("env", F.sqrt(F.sum(F.col(x) * F.col(x)).over(w) / n))


def rising_edges(samples: DataFrame, key: str, at: str, x: str, share: float = 0.22) -> DataFrame:
    """How often the value crosses share of its maximum upward."""
    on = samples.withColumn("on", F.col(x) > share * F.max(x).over(W.partitionBy(key)))
    return on.withColumn("edge", F.col("on") & ~F.coalesce(F.lag("on").over(W.partitionBy(key).orderBy(at)), F.lit(False))).groupBy(key).agg(F.count_if("edge").alias("edges"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def bed_mix(voice: Column, bed: Column, level: float, top: float = 0.85) -> Column:
    """The voice brought to a peak of `top`, with the bed looped under it, cut at full scale."""
    gain = top / F.nullif(peak(voice), F.lit(0.0))
    return F.transform(voice, lambda x, i: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * F.coalesce(gain, F.lit(1.0)) + F.element_at(bed, i % F.size(bed) + 1) * level)))


def _by_length(frames: pd.Series, run) -> pd.Series:
    """run(matrix of frames of one length) -> rows, for all frames; null and empty frames give null."""
    out = pd.Series([None] * len(frames), dtype=object)
    sizes = frames.map(lambda x: 0 if x is None else len(x)).to_numpy()
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        out.iloc[at] = list(run(np.stack([np.asarray(frames.iloc[i], float) for i in at])))
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def spectrum(frames: pd.Series) -> pd.Series:
    """Magnitudes of a Hann-windowed frame."""
    return _by_length(frames, lambda x: np.abs(np.fft.rfft(x * np.hanning(x.shape[1] + 1)[:-1], axis=1)))


@F.pandas_udf(T.DoubleType())
def periodicity(frames: pd.Series) -> pd.Series:
    """Highest normalised autocorrelation beyond the first dip."""

    def run(x):
        n = x.shape[1]
        x = x - x.mean(1, keepdims=True)
        full = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n, axis=1)) ** 2, axis=1)[:, :n]
        full = np.where(np.abs(full) < 1e-12 * np.maximum(full[:, :1], 1e-300), 0.0, full)
        after = np.logical_or.accumulate(full < 0, axis=1)
        best = np.where(after, full, -np.inf).max(1)
        return np.where((full[:, 0] > 0) & after.any(1), best / np.where(full[:, 0] > 0, full[:, 0], 1.0), 0.0)

    return _by_length(frames, run).astype("float64")
