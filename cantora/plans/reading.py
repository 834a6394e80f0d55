"""A reading script: sentences up to a target time, with marks to breathe at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def script(sentences: DataFrame, key: str, at: str, text: str, target_s: float, pace: float = 9.0, every: int = 10) -> DataFrame:
    """Rows of each key until the time before them reaches target_s (the first row always stays), with the running time and a mark on each `every`th and the last one."""
    w = W.partitionBy(key).orderBy(at)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    # whole characters are summed, so that the time does not depend on the order of additions
    rows = sentences.withColumn("_chars", F.length(text)).withColumn("_sum", F.sum("_chars").over(so_far)).withColumn("place", F.row_number().over(w))
    kept = rows.filter((F.col("place") == 1) | ((F.col("_sum") - F.col("_chars")) / pace < target_s))
    last = F.lead(F.lit(True)).over(w).isNull()
    return kept.withColumn("mark", (F.col("place") % every == 0) | last).withColumn("running_s", F.col("_sum") / pace).drop("_chars", "_sum")


def within(rows: DataFrame, key: str, at: str, seconds, budget_s: float = 26.0) -> DataFrame:
    """The leading rows of each key whose seconds together stay within a budget: the row that would go over it and all after it are left out; the first always stays."""
    w = W.partitionBy(key).orderBy(at)
    # thousandths are summed, so that the sum does not depend on the order of additions
    held = rows.withColumn("_sum", F.sum(F.rint(seconds * 1000).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_place", F.row_number().over(w))
    return held.filter((F.col("_sum") <= budget_s * 1000) | (F.col("_place") == 1)).drop("_sum", "_place")
