"""Exact percentiles from sketches, and the sketches' own error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantora.operators import percentiles as P

SHARES = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]


def test_exact(spark):
    rng = np.random.default_rng(1)
    sets = {"many": rng.normal(0, 9, 20000), "ties": rng.integers(0, 5, 3000).astype(float), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), None: rng.lognormal(0, 2, 500)}
    rows = [(k, float(v)) for k, x in sets.items() for v in x] + [("many", None), ("many", float("nan")), ("none", None)]
    got = {r.k: (r.n, r["values"]) for r in P.percentiles(spark.createDataFrame(rows, "k string, x double").repartition(5), "k", "x", SHARES).collect()}
    assert got.keys() == sets.keys()
    for k, x in sets.items():
        assert got[k][0] == len(x) and got[k][1] == pytest.approx(np.percentile(x, [100 * p for p in SHARES]).tolist())


def test_a_missed_bracket_is_widened(spark, monkeypatch):
    monkeypatch.setattr(P, "SLACKS", (1e-9, 1.0))
    monkeypatch.setattr(P, "SIZE", 8)
    df = spark.range(5000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("x"))
    assert P.percentiles(df, "k", "x", [0.3, 0.6]).first()["values"] == pytest.approx([4999 * 0.3, 4999 * 0.6])


def test_sketches_of_chunks_merge(spark):
    df = spark.range(400_000).select(F.lit("clip").alias("k"), (F.col("id") % 13).alias("chunk"), ((F.col("id") * 7919) % 400_000).cast("double").alias("x"))
    whole = P.merged(P.sketched(df, ["k", "chunk"], "x"), ["k"])
    row = P.quantiles(whole, ["k"], SHARES).first()
    assert row.n == 400_000 and all(abs(v / 400_000 - p) < 0.01 for v, p in zip(row["values"], SHARES, strict=True))
    assert whole.select(F.length("sketch")).first()[0] < 1 << 16
