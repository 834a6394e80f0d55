"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import frozen

WEIGHTS = (5, 2, 1)
#: Rows of a sorted block, about, and such blocks of a source at most (a block grows beyond that).
BLOCK_ROWS, MOST_BLOCKS = 2048, 1 << 14
#: Words of a drawn block (more beyond 2^28 blocks) and of an output shard, about.
UNIT, SHARD_WORDS = 1 << 10, 1 << 24
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], share: float = 1.0, most: float = 3.0, weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """Each source's target: `share` of all sizes by weight; a target stops at `most` times its source's size and the excess is shared again by weight."""
    total, out, open_ = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in set(open_))
        weight = sum(weights[i % len(weights)] for i in open_)
        full = [i for i in open_ if left * weights[i % len(weights)] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i % len(weights)] / weight
            break
        for i in full:
            out[i] = most * sizes[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def shard_quotas(blocks: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's blocks each shard gets, as a shards x sources array.

    A tree over the shards: of a node's blocks its left half draws its share from the multivariate hypergeometric law, the
    right half gets the rest. Every source's column adds up to its blocks, shards' sums differ by one at most.
    """
    out = np.zeros((shards, len(blocks)), np.int64)
    stack = [(0, shards, np.asarray(blocks, np.int64))]
    while stack:
        lo, hi, held = stack.pop()
        if hi - lo == 1:
            out[lo] = held
            continue
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(held, int(held.sum()) * (mid - lo) // (hi - lo), method="marginals")
        stack += [(lo, mid, left), (mid, hi, held - left)]
    return out


def mix(docs: DataFrame, share: float = 1.0, most: float = 3.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 9, whole: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, size (words), source_size, target, taken, shards (of each time it is taken); with whole the columns of docs under `row`, and `h`.

    Each source's documents are permuted by a hash of id and text; its target is taken along that order, in whole passes and
    a part of one: the document at the end in part, or (whole=True) as a whole if at least half of it is due. What is taken
    is cut into blocks of equal length, and a splitting tree (shard_quotas) says how many blocks of each source each output
    shard gets; shards take their blocks of the permuted order one after another, so blocks are disjoint. A document is in
    the shard of its first word. Reruns agree, whatever the partitions. The driver holds a few numbers a source, and one a
    source and shard. Sources sort by code point, null last. A null text has size 0 and is never taken; null and repeated ids
    are rows like any other; an empty table gives no rows.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed).cast("long"), "doc_id", "text").alias("h")]
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *own) if whole else frozen(docs.select(*own))
    sources = keyed.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")).collect()
    sources.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    spark, plan = docs.sparkSession, []
    for k, (r, t) in enumerate(zip(sources, targets([r["words"] for r in sources], share, most, weights), strict=True)):
        passes = int(t // r["words"]) if r["words"] else 0
        plan.append((r["source"], int(r["words"]), float(t), max(1, min(MOST_BLOCKS, -(-r["rows"] // BLOCK_ROWS))), passes, round(t - passes * r["words"]), k))
    table = spark.createDataFrame(plan, "source string, source_size long, target double, blocks int, passes long, quota long, at int")
    take = np.array([p[1] * p[4] + p[5] for p in plan], np.int64)
    unit = max(UNIT, int(take.sum()) >> 28)
    shards = max(64, 1 << (int(take.sum()) // SHARD_WORDS).bit_length())
    ends = np.cumsum(shard_quotas(-(-take // unit), shards, np.random.default_rng(seed)), 0)
    sent = spark.sparkContext.broadcast(ends)

    # one row a source
    held = keyed.join(F.broadcast(table), keyed["source"].eqNullSafe(table["source"])).drop("source")
    # blocks of the permuted order are ranges of h, so that no task sorts a source
    held = held.withColumn("block", ((F.shiftrightunsigned("h", 32) * F.col("blocks").cast("long")) / F.lit(float(1 << 32))).cast("int"))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    blocks = held.groupBy("at", "block").agg(F.sum("size").alias("size")).select("at", "block", before(W.partitionBy("at").orderBy("block")).alias("start"))
    order = W.partitionBy("at", "block").orderBy(F.shiftrightunsigned("h", 1), "h", "doc_id")
    placed = held.withColumn("before", before(order)).join(blocks, ["at", "block"]).withColumn("pos", F.col("start") + F.col("before"))
    part = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("quota") - F.col("pos")))
    if whole:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def homes(cols: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for cols_ in cols:
            at, pos, wide, times = (c.to_numpy(zero_copy_only=False) for c in cols_)
            row = np.repeat(np.arange(len(at)), times)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            block = np.minimum(pos[row] + nth * wide[row], take[at[row]] - 1) // unit
            home = np.zeros(len(row), np.int32)
            for k in np.unique(at[row]):
                mine = at[row] == k
                home[mine] = np.searchsorted(sent.value[:, k], block[mine], "right")
            yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(times)).astype(np.int32)), pa.array(home))

    part = part.alias("part")
    out = placed.withColumn("part", part).withColumn("times", F.when(F.col("size") > 0, F.col("passes") + (F.col("part") > 0).cast("long")).otherwise(F.lit(0).cast("long")))
    out = out.withColumn("shards", homes("at", "pos", "source_size", "times"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).alias("taken"), "shards", *(["row", "h"] if whole else []))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it, dealt by shard and shuffled inside each; no row is cut.

    Columns stay as they are, whatever their names. Rows of size 0 go; repeated rows are rows like any other; an empty table
    stays empty.
    """
    got = mix(docs, whole=True, **options)
    dealt = got.select("row", "h", F.posexplode("shards").alias("nth", "shard")).repartition("shard")
    return dealt.sortWithinPartitions("shard", F.xxhash64(F.lit(1).cast("long"), "h", "nth")).select("row.*")
