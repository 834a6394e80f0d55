"""Exact dedup by two-pass Bloom filtering."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .shared import frozen, give_back, partitions, string_buffers

#: Bits of a filter for each key.
KEY_BITS = 10


@F.arrow_udf(T.BinaryType())
def digest(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """SHA-256 of each text after lower-casing A-Z (null: empty). Only the text goes to Python."""
    for text in cols:
        yield pa.array(_shas(text), pa.binary())
    give_back()


def _shas(text: pa.Array) -> list[bytes]:
    raw, off = string_buffers(text)
    shas = []
    for lo in range(0, len(text), 256):
        at = off[lo : lo + 257].tolist()
        data = raw[at[0] : at[-1]].tobytes()
        shas += [hashlib.sha256(data[a - at[0] : b - at[0]].lower()).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
    return shas


def _repeat_filter(digests: DataFrame, rows: int, filter_bits: int):
    """Pass 1: a broadcast filter of the digests that may come twice. A task notes each bit met once and each met again; two tasks that both met a bit once make it met again."""
    spark = digests.sparkSession
    bits = bloom.bits_for(rows, KEY_BITS, filter_bits)
    shape = "seg int, once binary, again binary"

    def note(batches):
        once, again = {}, {}
        for batch in batches:
            keys = _keys(batch.column("sha"))
            segs = (keys >> np.uint64(64 - bloom.SEGMENT_BITS)).astype(np.int64)
            for s in np.unique(segs):
                s = int(s)
                own = keys[segs == s]
                count = np.bincount(_own_places(own, s, bits), minlength=bits)
                a = once.setdefault(s, np.zeros(bits, bool))
                b = again.setdefault(s, np.zeros(bits, bool))
                b |= (count > 1) | (a & (count > 0))
                a |= count > 0
        pack = lambda x: np.packbits(x, bitorder="little").tobytes()
        yield pa.record_batch([pa.array(list(once), pa.int32()), pa.array([pack(x) for x in once.values()], pa.binary()), pa.array([pack(x) for x in again.values()], pa.binary())], names=["seg", "once", "again"])

    def merge(batches):
        once, again = {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                s, a, b = row["seg"], np.frombuffer(row["once"], np.uint8), np.frombuffer(row["again"], np.uint8)
                if s in once:
                    again[s] = again[s] | b | (once[s] & a)
                    once[s] = once[s] | a
                else:
                    once[s], again[s] = a, b
        yield pa.record_batch([pa.array(list(again), pa.int32()), pa.array([x.tobytes() for x in again.values()], pa.binary())], names=["seg", "again"])

    got = digests.select("sha").mapInArrow(note, shape).repartition(min(32, partitions(spark)), "seg").mapInArrow(merge, "seg int, again binary").collect()
    return spark.sparkContext.broadcast(bloom.joined(got, bits)), bits


def _keys(col) -> np.ndarray:
    raw, off = string_buffers(col)
    return np.frombuffer(raw[off[0] : off[-1]].tobytes(), ">u8").reshape(-1, 4)[:, 0].astype(np.uint64) if len(off) > 1 else np.zeros(0, np.uint64)


def _own_places(keys: np.ndarray, seg: int, bits: int) -> np.ndarray:
    """Places of each key in its segment. A key counts once for a place that two of its probes share."""
    at = np.sort(np.stack([bloom._places(keys, bits, j) - seg * bits for j in range(bloom.PROBES)]), axis=0)
    fresh = np.ones(at.shape, bool)
    fresh[1:] = at[1:] != at[:-1]
    return at[fresh]


def _again(found, bits: int):
    """A column: whether the filter may have met the digest `sha` twice."""

    @F.arrow_udf(T.BooleanType())
    def probe(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for sha in cols:
            yield pa.array(bloom.has(_keys(sha), bits, found.value))
        give_back()

    return probe(F.col("sha"))


def _tagged(found, bits: int):
    """A column: the digest of `text`, and whether the filter may have met it twice; one Python worker does both."""

    @F.arrow_udf(T.StructType([T.StructField("sha", T.BinaryType()), T.StructField("again", T.BooleanType())]))
    def tag(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in cols:
            sha = pa.array(_shas(text), pa.binary())
            yield pa.StructArray.from_arrays([sha, pa.array(bloom.has(_keys(sha), bits, found.value))], ["sha", "again"])
        give_back()

    return tag(F.col("text"))


def _marked(digests: DataFrame, rows: DataFrame, filter_bits: int) -> DataFrame:
    """rows (with `sha`, or `text` to take it from) with `again`: whether the digests may hold the row's digest twice.

    A filter has KEY_BITS bits a key. Where that is more than filter_bits, digests fall into slices by their last bytes, and each slice
    has a filter of its own, so no worker holds more than filter_bits at once and the share of false hits is the same at any size.
    """
    total = digests.count()
    slices = max(1, -(-total * KEY_BITS // filter_bits))
    if slices == 1:
        found = _repeat_filter(digests, total, filter_bits)
        return rows.withColumn("again", _again(*found)) if "sha" in rows.columns else rows.withColumn("_t", _tagged(*found)).select(*[c for c in rows.columns if c != "text"], "_t.*")
    rows = rows if "sha" in rows.columns else rows.withColumn("sha", digest("text")).drop("text")
    own = lambda k: F.pmod(F.hash("sha"), F.lit(slices)) == k
    parts = [rows.filter(own(k)).withColumn("again", _again(*_repeat_filter(digests.filter(own(k)), -(-total // slices), filter_bits))) for k in range(slices)]
    return reduce(DataFrame.unionByName, parts)


def exact_dedup(docs: DataFrame, filter_bits: int = 1 << 28) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest
    doc_id stays (null ids count as smallest; rows that share that id and text all show kept). Pass 1 builds filters of
    digests that may come twice, sized by the rows (see _marked); in pass 2 only such rows (digest and id) shuffle. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = frozen(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest("text").alias("sha")))
    marked = _marked(rows, rows, filter_bits)
    alone = marked.filter("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    maybe = marked.filter("again").select("doc_id", "sha")
    groups = maybe.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # another key than the grouping's, so that both sides are dealt for the join and a hot group can be split
    joined = maybe.withColumn("_k", F.xxhash64("sha")).alias("m").join(groups.withColumn("_k", F.xxhash64("sha")).alias("g"), (F.col("m._k") == F.col("g._k")) & (F.col("m.sha") == F.col("g.sha")))
    met = joined.select("m.doc_id", "keep_id", "group_size", F.col("m.doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "m.sha")
    return alone.unionByName(met).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def dedup_rows(docs: DataFrame, filter_bits: int = 1 << 28) -> DataFrame:
    """docs without the rows whose text (A-Z lower-cased, null as empty) another row with a larger doc_id has; of rows equal in text and doc_id one stays.

    Rows that the filter takes for single pass straight through and never leave the JVM; the others meet by digest, whole,
    after each task has kept the best of its own. Null ids count as smallest; all columns stay as they are, whatever their
    names; an empty table stays empty. docs is read once for the digests and once for each filter slice.
    """
    digests = frozen(docs.select(digest("text").alias("sha")))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), "text")
    marked = _marked(digests, keyed, filter_bits)
    alone = marked.filter("not again").select("_row.*")
    best = marked.filter("again").groupBy("sha").agg(F.max_by("_row", F.coalesce("_id", F.lit(-(2**63)))).alias("_row"))
    return alone.unionByName(best.select("_row.*"))
