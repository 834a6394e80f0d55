"""Approximate nearest neighbours by cross-polytope hashing with multiprobe and exact reranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import frozen, partitions

#: Tables; the recall that probing is set to reach, and the queries of each vector length on which it is measured, at most.
TABLES, RECALL, MEASURED = 8, 0.95, 64
#: Rows of a bucket that one task compares with the bucket's queries.
BLOCK = 8192


def _rotation(d: int, table: int, seed: int) -> np.ndarray:
    """Random signs for three Hadamard rounds."""
    return np.random.default_rng([seed, table, d]).choice(np.array([-1.0, 1.0]), (3, d))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Pseudo-rotation of rows whose length is a power of two: signs, then a fast Hadamard transform, three times."""
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
            h *= 2
        x = x / np.sqrt(d)
    return x


def _unit(x: np.ndarray, longest: float | None, query: bool) -> np.ndarray:
    """Rows as unit vectors of a power-of-two length. With unequal lengths (longest is given) a row gets one more coordinate, so that the order by inner product becomes one by angle."""
    n, d = x.shape
    out = np.zeros((n, 1 << int(d - 1 + (longest is not None)).bit_length()))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    if longest is None or query:
        out[:, :d] = x / norm
    else:
        out[:, :d] = x / longest
        out[:, d] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / longest) ** 2))
    return out


def _matrix(col) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _buckets(rows: DataFrame, tables: int, longest: dict[int, float | None], probes: dict[int, int] | None, seed: int) -> DataFrame:
    """rows (id, d, v, ...) once for each table and bucket. probes None: a data row's own bucket; else a query's nearest ones."""
    names = ["id", "d", "v"]

    def run(batches):
        for batch in batches:
            dims = np.array(batch.column("d").to_pylist())
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d)).select(names)
                x = _unit(_matrix(part.column("v")), longest[int(d)], probes is not None)
                width = x.shape[1]
                for t in range(tables):
                    r = rotate(x, _rotation(width, t, seed))
                    signed = np.concatenate([r, -r], 1)
                    if probes is None:
                        own, at = signed.argmax(1), np.arange(len(r))
                    else:
                        k = min(2 * width, probes.get(int(d), 2 * width))
                        own = np.argsort(-signed, axis=1, kind="stable")[:, :k].reshape(-1)
                        at = np.repeat(np.arange(len(r)), k)
                    out = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(len(at), t), pa.int32()), pa.array(own.astype(np.int32))], names=[*names, "t", "bucket"])

    return rows.select(*names).mapInArrow(run, "id long, d int, v array<double>, t int, bucket int")


def _search(data: DataFrame, queries: DataFrame, k: int, tables: int, longest: dict[int, float | None], probed: dict[int, int], seed: int) -> DataFrame:
    """(q, id, score): the k best candidates that each query's buckets hold; q numbers distinct query vectors."""
    n = partitions(data.sparkSession)
    placed = _buckets(data, tables, longest, None, seed)
    asked = _buckets(queries, tables, longest, probed, seed)
    sizes = placed.groupBy("d", "t", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    # one row a bucket: tables x 2 x width rows for each vector length
    here = placed.join(F.broadcast(sizes), ["d", "t", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    there = asked.join(F.broadcast(sizes), ["d", "t", "bucket"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ["d", "t", "bucket", "block", "id", "v"]
    both = here.select(*cols, F.lit(False).alias("asks")).unionByName(there.select(*cols, F.lit(True).alias("asks")))

    def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray):
        """Distinct (q, id) rows, the k best of each q, ties to smaller ids."""
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, scores = q[new], ids[new], scores[new]
        start = np.searchsorted(q, q)
        keep = np.arange(len(q)) - start < k
        return q[keep], ids[keep], scores[keep]

    def compare(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        table = table.sort_by([(c, "ascending") for c in ("d", "t", "bucket", "block")])
        key = np.stack([table.column(c).to_numpy() for c in ("d", "t", "bucket", "block")], 1)
        asks = table.column("asks").to_numpy()
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            mark = asks[a:b]
            if mark.all() or not mark.any():
                continue
            part = table.slice(a, b - a)
            v, ids = _matrix(part.column("v")), part.column("id").to_numpy()
            x, y, qs, xs = v[~mark], v[mark], ids[mark], ids[~mark]
            for lo in range(0, len(y), 512):
                s = y[lo : lo + 512] @ x.T
                if s.shape[1] > k:
                    cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    i, j = np.nonzero(s >= (cut - 1e-9 * np.maximum(1, np.abs(cut)))[:, None])
                else:
                    i, j = (z.reshape(-1) for z in np.indices(s.shape))
                exact = (y[lo + i] * x[j]).sum(1)  # in one order for all, so that equal vectors score the same
                # each bucket tells its own best, so that what a query gets does not depend on how buckets fall to tasks
                q, ids_, scores = best(qs[lo + i], xs[j], exact)
                yield pa.record_batch([pa.array(q), pa.array(ids_), pa.array(scores)], names=["q", "id", "score"])

    found = both.repartition(n, "d", "t", "bucket", "block").mapInArrow(compare, "q long, id long, score double").groupBy("q", "id").agg(F.max("score").alias("score"))
    return found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k).drop("r")


def probes_for(data: DataFrame, queries: DataFrame, k: int, tables: int, longest: dict[int, float | None], recall: float, seed: int) -> dict[int, int]:
    """Of each vector length, how many buckets of each table a query must probe so that `recall` of the true neighbours are met, measured on up to MEASURED queries against all rows.

    One pass over data scores the sample exactly; a neighbour's place is the least, over the tables, of its bucket's place in
    the query's order. So probing follows the data: closer neighbours, or lengths that differ, need no setting.
    """
    few = queries.withColumn("_r", F.row_number().over(W.partitionBy("d").orderBy(F.xxhash64("id")))).filter(F.col("_r") <= MEASURED).select("id", "d", "v").collect()
    sample = {}
    for d in sorted({r["d"] for r in few}):
        own = [r for r in few if r["d"] == d]
        x = np.array([r["v"] for r in own])
        unit = _unit(x, longest[d], True)
        order = []
        for t in range(tables):
            r = rotate(unit, _rotation(unit.shape[1], t, seed))
            place = np.argsort(np.argsort(-np.concatenate([r, -r], 1), axis=1, kind="stable"), axis=1)
            order.append(place)
        sample[d] = np.array([r["id"] for r in own]), x, order
    sent = data.sparkSession.sparkContext.broadcast(sample)

    def meet(batches):
        for batch in batches:
            dims = np.array(batch.column("d").to_pylist())
            for d in np.unique(dims) if len(dims) else []:
                if int(d) not in sent.value:
                    continue
                ids, x, order = sent.value[int(d)]
                part = batch.filter(pa.array(dims == d))
                v, rows = _matrix(part.column("v")), part.column("id").to_numpy()
                scores = np.where(rows[None] == ids[:, None], -np.inf, x @ v.T)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                need = np.unique(best)
                unit = _unit(v[need], longest[int(d)], False)
                least = np.full((len(ids), len(need)), 1 << 30)
                for t in range(tables):
                    r = rotate(unit, _rotation(unit.shape[1], t, seed))
                    least = np.minimum(least, order[t][:, np.concatenate([r, -r], 1).argmax(1)])
                q = np.repeat(np.arange(len(ids)), best.shape[1])
                at = best.reshape(-1)
                keep = np.isfinite(scores[q, at])
                q, at = q[keep], at[keep]
                yield pa.record_batch([pa.array(np.full(len(q), d, np.int32)), pa.array(q), pa.array(rows[at]), pa.array(scores[q, at]), pa.array(least[q, np.searchsorted(need, at)])], names=["d", "q", "id", "score", "place"])

    near = data.select("id", "d", "v").mapInArrow(meet, "d int, q long, id long, score double, place long")
    told = near.withColumn("_r", F.row_number().over(W.partitionBy("d", "q").orderBy(F.desc("score"), "id"))).filter(F.col("_r") <= k).groupBy("d", "place").count().collect()
    out = {}
    for d in sample:
        by = sorted((r["place"], r["count"]) for r in told if r["d"] == d)
        want, have = recall * sum(n for _, n in by), 0
        for place, n in by:
            have += n
            out[d] = int(place) + 1
            if have >= want:
                break
    return out


def nearest(vectors: DataFrame, queries, k: int = 20, tables: int = TABLES, recall: float = RECALL, seed: int = 6) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `queries` selects, its k nearest other rows by inner product in double precision, ties to smaller ids.

    Every row is indexed: in each table under the signed axis nearest to its pseudo-rotated vector. A query probes the
    nearest signed axes of each table, as many as probes_for finds to be needed, and ranks all that it finds exactly. Queries
    that find fewer than k rows search once more in all buckets, so each gets min(k, all) rows. A large bucket is compared in
    blocks. Of equal vectors only the k + 1 smallest ids can be in an answer, so the index keeps those, and equal queries
    search once. Vectors that are null, zero or hold a null or non-finite component take no part, nor do null ids; vectors of
    different lengths are not compared; repeated (id, vector) rows count once; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = frozen(vectors.filter(sound).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), F.size(v).alias("d"), F.coalesce(queries, F.lit(False)).alias("asks")).withColumn("h", F.xxhash64("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    spread = rows.groupBy("d").agg(F.min(norm).alias("lo"), F.max(norm).alias("hi")).collect()
    longest = {r["d"]: r["hi"] if r["hi"] - r["lo"] > 1e-3 * r["hi"] else None for r in spread}
    # of a vector that a third of all rows share each task keeps the k + 1 least ids, so no window sorts them all
    least = F.slice(F.array_sort(F.collect_set("id")), 1, k + 1)
    part = F.pmod(F.xxhash64("id"), F.lit(64).cast("long"))
    once = rows.groupBy("h", "v", "d", part.alias("_p")).agg(least.alias("ids")).groupBy("h", "v", "d").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    data = frozen(once.select(F.explode("ids").alias("id"), "d", "v"))
    asked = rows.filter("asks").select("id", "h", "v", "d").distinct()
    named = asked.groupBy("h", "v", "d").agg(F.min("id").alias("q"))
    asked = frozen(asked.join(named.select(F.col("h").alias("_h"), F.col("v").alias("_v"), "q"), (F.col("h") == F.col("_h")) & (F.col("v") == F.col("_v"))).select("id", "h", "v", "d", "q"))
    distinct = asked.filter("id = q").dropDuplicates(["q", "h"]).select(F.col("q").alias("id"), "d", "v")
    probed = probes_for(data, distinct, k, tables, longest, recall, seed)
    found = frozen(_search(data, distinct, k + 1, tables, longest, probed, seed))
    reach = data.groupBy("d").agg(F.least(F.count(F.lit(1)), F.lit(k + 1)).alias("reach"))
    few = frozen(distinct.join(F.broadcast(reach), "d").join(found.groupBy("q").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("q", "id"), "id", "left").filter(F.coalesce("n", F.lit(0)) < F.col("reach")).select("id", "d", "v"))
    if not few.isEmpty():
        found = found.join(few.select(F.col("id").alias("q")), "q", "left_anti").unionByName(_search(data, few, k + 1, 1, longest, {}, seed))
    out = asked.select(F.col("id").alias("query_id"), "q").dropDuplicates().join(found, "q").filter(F.col("query_id") != F.col("id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.select("query_id", rank.cast("int").alias("rank"), F.col("id").alias("vec_id"), "score").filter(F.col("rank") <= k)
