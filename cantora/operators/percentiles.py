"""Percentiles of keys of any size: mergeable sketches for chunks, and exact values from the few rows that a sketch brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Size of a sketch (its rank error is about 0.2 %), and half the width of a bracket in ranks; wider ones follow if one misses.
SIZE, SLACKS = 2048, (0.01, 0.1, 1.0)


def sketched(rows: DataFrame, keys: list[str], x: str, size: int = SIZE) -> DataFrame:
    """keys, n and a sketch of x, a few kilobytes however many rows; keys may name a clip's chunks. Null and NaN values do not count."""
    v = F.col(x).cast("double")
    return rows.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of chunks as one for each of the fewer keys."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys, n and the approximate values at the shares (0 to 1), as an array."""
    return sketches.select(*keys, "n", F.array(*(F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in shares)).alias("values"))


def percentiles(rows: DataFrame, key: str, x: str, shares: list[float]) -> DataFrame:
    """key, n and the exact values at the shares, with linear interpolation, as an array.

    One pass sketches each key; a second counts what lies below a bracket of ranks around each share and keeps the bracket's
    values alone, so that no task holds a key's rows. A bracket that misses its ranks is known by its counts, and a wider one
    is taken. Null and NaN values do not count; keys without others do not come; null is a key.
    """
    of = rows.select(F.col(key).alias("_key"), F.col(x).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    sketches = sketched(of, ["_key"], "_x")
    got = None
    for slack in SLACKS:
        at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, p))))
        low = lambda p, s=slack: F.lit(float("-inf")) if p - s <= 0 else at(p - s)
        high = lambda p, s=slack: F.lit(float("inf")) if p + s >= 1 else at(p + s)
        brackets = sketches.select("_key", "n", F.array(*(F.struct(F.lit(i).alias("i"), low(p).alias("a"), high(p).alias("b"), (F.lit(float(p)) * (F.col("n") - 1)).alias("rank")) for i, p in enumerate(shares))).alias("_b"))
        both = of.alias("v").join(brackets.alias("k"), F.col("v._key").eqNullSafe(F.col("k._key"))).select("k._key", "n", "_b", "_x")
        placed = both.select("_key", "n", "_x", F.explode("_b").alias("_b")).filter(F.col("_x") <= F.col("_b.b"))
        # what lies below a bracket is one count, what lies inside one count for each value
        own = F.when(F.col("_x") >= F.col("_b.a"), F.col("_x"))
        counts = placed.groupBy("_key", "n", F.col("_b.i").alias("i"), F.col("_b.rank").alias("rank"), own.alias("x")).agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(W.partitionBy("_key", "i").orderBy(F.asc_nulls_first("x")))
        counts = counts.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("c"))
        has = lambda r: F.max(F.when((F.col("_from") <= r) & (r < F.col("_to")), F.col("x")))
        lo, hi = F.floor("rank"), F.ceil("rank")
        found = counts.groupBy("_key", "n", "i", "rank").agg(has(lo).alias("lo"), has(hi).alias("hi"))
        value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("rank") - F.floor("rank"))
        got = found.groupBy("_key", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("value")))), lambda s: s["value"]).alias("values"))
        if slack == SLACKS[-1] or not got.filter(F.exists("values", lambda v: v.isNull()) | (F.size("values") < len(shares))).head(1):
            return got.withColumnRenamed("_key", key)
    return got
