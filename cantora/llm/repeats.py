"""Exact removal of repeated runs of units (words or bytes), without comparing all pairs of their places.

A window is `length` consecutive units of one document. A document's row is told by (doc_id, CRC-32 of its text). The
result marks each window whose content also starts earlier: in a row with a smaller doc_id, or earlier in the same row.

1. Seeds. Each window has one anchor: the smallest hash of its runs of `seed` units (winnowing), which equal windows
   share at the same offset. Only anchors met twice can lie in a repeat; a bounded Bloom filter holds these.
2. Extension. Each place of such an anchor is extended both ways, as far as its windows reach (less at a document's
   ends). Places of one anchor with the same extension have the same windows: all but the first of them are repeats.
3. Where one anchor has several extensions, the first place of each extension meets the others window by window.

Each step shuffles packed arrays keyed by anchor. A chunk of documents sends each extension once, so a passage that a
third of all rows share meets in one task as often as there are chunks. A full filter lets more through, which costs
shuffle volume and changes no result.

Rows with a null text count as empty; a null doc_id sorts first. Rows that agree in doc_id and text start nowhere
earlier than each other, so neither is removed because of the other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from . import bloom
from .arrays import U
from .shared import NO_ID, chunks, frozen, ids_of, partitions

PARTS = 1024
_PACK = "part int, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
_PACK_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcdef")])
_SPANS = "doc_id long, fp long, spans binary"
_SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("spans", pa.binary())])


@dataclass(frozen=True)
class Repeats:
    """unit: word or byte; length and seed in units; chunk_bytes: text handled at once; filter_bits: most bits of a filter; position_bits: bits of a hash that give way to a place while the least of a window is found, in pieces of so many places."""

    unit: str
    length: int
    seed: int
    chunk_bytes: int = 2 << 20
    filter_bits: int = 1 << 28
    flush: int = 1 << 20
    position_bits: int = 24

    # -- arrays of one chunk -------------------------------------------------------------------------------------

    def _units(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A symbol for each unit and the first unit's index of each text."""
        if self.unit == "byte":
            return A.BYTE[raw], off
        starts, ends, first = A.words(raw, off)
        return A.word_hashes(raw, starts, ends), first

    def _anchors(self, raw: np.ndarray, off: np.ndarray):
        """Prefix sums; units' bounds of texts; of each anchor's place: text, position, id, first and last window. None if no text is long enough."""
        sym, first = self._units(raw, off)
        n, size = len(sym), self.length
        if n < size:
            return None
        sums = A.prefix(sym)
        at = np.arange(n - self.seed + 1)
        seeds = A.ranges(sums, at, at + self.seed)
        places = A.least_places(seeds, size - self.seed + 1, self.position_bits)
        live = np.zeros(n + 1, np.int32)
        lengths = np.diff(first)
        long = lengths >= size
        live[first[:-1][long]] += 1
        live[first[1:][long] - size + 1] -= 1
        windows = np.flatnonzero(np.cumsum(live)[: n - size + 1])
        if not len(windows):
            return None
        place = places[windows]
        new = np.flatnonzero(A.firsts(place))
        last = np.append(new[1:], len(windows)) - 1
        p = place[new]
        doc = np.searchsorted(first, p, "right") - 1
        return sums, first, doc, p, A.mix(seeds[p] + U(0x51ED270B)), windows[new], windows[last]

    def _contexts(self, sums, first, doc, p) -> np.ndarray:
        lo = np.maximum(first[doc], p - (self.length - self.seed))
        hi = np.minimum(first[doc + 1], p + self.length)
        return A.mix(A.ranges(sums, lo, hi) + (p - lo).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))

    # -- tasks ---------------------------------------------------------------------------------------------------

    def _seed_task(self):
        def run(batches):
            held, count = [], 0
            for _, _, _, raw, off in chunks(batches, self.chunk_bytes):
                got = self._anchors(raw, off)
                if got is None:
                    continue
                ids, times = np.unique(got[4], return_counts=True)
                held.append(np.concatenate([ids, ids[times > 1]]))
                count += len(held[-1])
                if count >= self.flush:
                    yield _parts(0, np.concatenate(held), [])
                    held, count = [], 0
            if held:
                yield _parts(0, np.concatenate(held), [])

        return run

    def _place_task(self, filled, bits: int):
        def run(batches):
            for batch, lo, hi, raw, off in chunks(batches, self.chunk_bytes):
                got = self._anchors(raw, off)
                if got is None:
                    continue
                sums, first, doc, p, anchor, s1, s2 = got
                seen = bloom.has(anchor, bits, filled.value)
                doc, p, anchor, s1, s2 = (x[seen] for x in (doc, p, anchor, s1, s2))
                if not len(p):
                    continue
                ids, prints = ids_of(batch, lo, hi), _prints(raw, off)
                ctx, at = self._contexts(sums, first, doc, p), p - first[doc]
                ids, prints = ids[doc], prints[doc]
                order = np.lexsort((at, ids, ctx))
                ctx, ids, prints, at, anchor, before, wide = (x[order] for x in (ctx, ids, prints, at, anchor, p - s1, s2 - s1))
                head, later = _later(ids, at, ctx)
                yield _parts(0, anchor[head], [anchor[head], ctx[head], ids[head], prints[head], at[head].astype(np.int32), (before[head] << 16 | wide[head]).astype(np.int32)])
                if later.any():
                    start = (at - before)[later]
                    yield _parts(1, anchor[later], [ids[later], prints[later], start.astype(np.int32), (start + wide[later] + self.length).astype(np.int32)])

        return run

    def _extend_task(self):
        def run(batches):
            shipped, spans = [[] for _ in range(6)], [[] for _ in range(4)]
            for batch in batches:
                for row in batch.to_pylist():
                    for to, c in zip(shipped if row["kind"] == 0 else spans, "abcdef", strict=False):
                        to.append(row[c])
            anchor, ctx, ids, prints, at, reach = (np.frombuffer(b"".join(x), k) for x, k in zip(shipped, ("u8", "u8", "i8", "u4", "i4", "i4"), strict=True))
            order = np.lexsort((at, ids, ctx, anchor))
            anchor, ctx, ids, prints, at, reach = (x[order] for x in (anchor, ctx, ids, prints, at, reach))
            head, later = _later(ids, at, anchor, ctx)
            start = at - (reach >> 16)
            own = [np.frombuffer(b"".join(x), k) for x, k in zip(spans, ("i8", "u4", "i4", "i4"), strict=True)]
            yield from _span_rows(*(np.concatenate([a, b[later]]) for a, b in zip(own, (ids, prints, start, start + (reach & 0xFFFF) + self.length), strict=True)), packed=True)
            anchor, ctx, ids, at = anchor[head], ctx[head], ids[head], at[head]
            first = A.firsts(anchor)
            several = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1] > 1 if len(anchor) else np.zeros(0, bool)
            if several.any():
                keys = _request(ctx[several], ids[several], at[several])
                yield pa.record_batch([[0], [2], [keys.tobytes()], *[[None]] * 5], schema=_PACK_ARROW)

        return run

    def _window_task(self, filled, bits: int):
        def run(batches):
            for batch, lo, hi, raw, off in chunks(batches, self.chunk_bytes):
                got = self._anchors(raw, off)
                if got is None:
                    continue
                sums, first, doc, p, anchor, s1, s2 = got
                ids, prints = ids_of(batch, lo, hi), _prints(raw, off)
                asked = bloom.has(_request(self._contexts(sums, first, doc, p), ids[doc], p - first[doc]), bits, filled.value)
                if not asked.any():
                    continue
                doc, anchor, s1, s2 = (x[asked] for x in (doc, anchor, s1, s2))
                part = (anchor >> U(54)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                doc, part, s1, n = doc[order], part[order], s1[order], (s2 - s1 + 1)[order]
                w = A.spread(s1, n)
                content = A.ranges(sums, w, w + self.length)
                ends = np.cumsum(n)
                for k in np.flatnonzero(A.firsts(part)):
                    e = k + int(np.searchsorted(part[k:], part[k], "right"))
                    cols = ids[doc[k:e]], prints[doc[k:e]], (s1[k:e] - first[doc[k:e]]).astype(np.int32), n[k:e].astype(np.int32), content[ends[k] - n[k] : ends[e - 1]]
                    yield pa.record_batch([[int(part[k])], [0], *([c.tobytes()] for c in cols), [None]], schema=_PACK_ARROW)

        return run

    def _match_task(self):
        def run(batches):
            cols = [[] for _ in range(5)]
            for batch in batches:
                for row in batch.to_pylist():
                    for to, c in zip(cols, "abcde", strict=True):
                        to.append(row[c])
            ids, prints, start, n, content = (np.frombuffer(b"".join(x), k) for x, k in zip(cols, ("i8", "u4", "i4", "i4", "u8"), strict=True))
            at, ids, prints = A.spread(start.astype(np.int64), n), np.repeat(ids, n), np.repeat(prints, n)
            order = np.lexsort((at, ids, content))
            ids, prints, at = ids[order], prints[order], at[order]
            _, later = _later(ids, at, content[order])
            ids, prints, at = ids[later], prints[later], at[later]
            order = np.lexsort((at, prints, ids))
            ids, prints, at = ids[order], prints[order], at[order]
            k, size = A.runs(ids, prints, step=at)
            yield from _span_rows(ids[k], prints[k], at[k], at[k] + size - 1 + self.length, packed=False)

        return run

    # -- the whole job -------------------------------------------------------------------------------------------

    def spans(self, docs: DataFrame) -> DataFrame:
        """(doc_id, fp, spans): for each row with repeats, its removed runs as packed int32 [start, end) pairs in units; a row may come several times."""
        spark, text = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text")
        n = partitions(spark)

        def repeated(batches):
            keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for batch in batches for x in batch.column("a"))]))
            yield pa.record_batch([[np.unique(keys[1:][keys[1:] == keys[:-1]]).tobytes()]], names=["keys"])

        seeds = frozen(text.mapInArrow(self._seed_task(), _PACK).select("part", "a").repartition(n, "part").mapInArrow(repeated, "keys binary"))
        places = text.mapInArrow(self._place_task(*key_filter(seeds, "keys", self.filter_bits)), _PACK)
        extended = frozen(places.repartition(n, "part").mapInArrow(self._extend_task(), _PACK))
        asked = key_filter(extended.filter("kind = 2"), "a", self.filter_bits)
        matched = text.mapInArrow(self._window_task(*asked), _PACK).repartition(n, "part").mapInArrow(self._match_task(), _SPANS)

        def unpack(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    ids, prints, start, end = (np.frombuffer(row[c], k) for c, k in zip("abcd", ("i8", "u4", "i4", "i4"), strict=True))
                    yield from _span_rows(ids, prints, start, end, packed=False)

        return extended.filter("kind = 1").select("a", "b", "c", "d").mapInArrow(unpack, _SPANS).unionByName(matched)


def key_filter(keys: DataFrame, column: str, filter_bits: int):
    """A broadcast filter of the packed 64-bit keys in a column, and the bits of a segment."""
    spark = keys.sparkSession
    count = (keys.agg(F.sum(F.octet_length(column))).first()[0] or 0) // 8
    bits = bloom.bits_for(count, 12, filter_bits)

    def fill(batches):
        held = [np.frombuffer(x.as_buffer(), np.uint64) for batch in batches for x in batch.column(0)]
        got = list(bloom.segments(np.concatenate(held), bits)) if held else []
        yield pa.record_batch([pa.array([s for s, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], names=["seg", "bits"])

    def merge(batches):
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["bits"], np.uint8)
                whole[row["seg"]] = whole[row["seg"]] | own if row["seg"] in whole else own
        yield pa.record_batch([pa.array(list(whole), pa.int32()), pa.array([x.tobytes() for x in whole.values()], pa.binary())], names=["seg", "bits"])

    shape = "seg int, bits binary"
    rows = keys.select(column).mapInArrow(fill, shape).repartition(min(16, partitions(spark)), "seg").mapInArrow(merge, shape).collect()
    return spark.sparkContext.broadcast(bloom.joined(rows, bits)), bits


def with_spans(docs: DataFrame, spans: DataFrame, filter_bits: int = 1 << 28) -> DataFrame:
    """docs' doc_id and text with a column of packed spans (null: nothing to remove). Rows that a filter of the spans' rows does not hold pass by the join."""
    spans = frozen(spans.groupBy("doc_id", "fp").agg(F.collect_list("spans").alias("spans")))
    packed = spans.mapInArrow(_packed_keys, "keys binary")
    filled, bits = key_filter(packed, "keys", filter_bits)

    @F.arrow_udf(T.BooleanType())
    def may(cols: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, fp in cols:
            yield pa.array(bloom.has(_row_keys(ids, fp), bits, filled.value))

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.crc32(F.coalesce("text", F.lit(""))).alias("_fp")).withColumn("_may", may("_id", "_fp"))
    alone = keyed.filter("NOT _may").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("spans"))
    return alone.unionByName(keyed.filter("_may").join(spans.withColumnsRenamed({"doc_id": "_id", "fp": "_fp"}), ["_id", "_fp"], "left").select("doc_id", "text", "spans"))


def _row_keys(ids: pa.Array, fp: pa.Array) -> np.ndarray:
    return A.mix(A.mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) + fp.to_numpy(zero_copy_only=False).astype(np.uint64))


def _packed_keys(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.record_batch([[_row_keys(batch.column("doc_id"), batch.column("fp")).tobytes()]], names=["keys"])


def merged(spans: list[bytes]) -> np.ndarray:
    """Packed spans as sorted, disjoint, not touching [start, end) rows."""
    pairs = np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    far = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > far[:-1]
    at = np.flatnonzero(new)
    return np.stack([pairs[at, 0], far[np.append(at[1:], len(pairs)) - 1]], 1)


def _prints(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    view = memoryview(np.ascontiguousarray(raw))
    return np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), np.uint32, len(off) - 1)


def _request(ctx: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return A.mix(ctx + A.mix(ids.astype(np.uint64) * U(0x9FB21C651E98DF25) + at.astype(np.uint64)))


def _later(ids: np.ndarray, at: np.ndarray, *group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group, id and position: the first of each group, and those that start after it."""
    head = A.firsts(*group)
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(head) else np.zeros(0, np.int64)
    return head, (ids != ids[first]) | (at != at[first])


def _parts(kind: int, anchor: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of packed columns, one for each part that anchors fall into."""
    part = (anchor >> U(54)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, cols = part[order], [c[order] for c in (cols or [anchor])]
    at = np.flatnonzero(A.firsts(part))
    end = np.append(at[1:], len(part))
    data = [pa.array([c[i:j].tobytes() for i, j in zip(at, end, strict=True)], pa.binary()) for c in cols]
    return pa.RecordBatch.from_arrays([pa.array(part[at], pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), *data, *(pa.nulls(len(at), pa.binary()) for _ in range(6 - len(cols)))], schema=_PACK_ARROW)


def _span_rows(ids, prints, start, end, packed: bool):
    """Spans, packed by document row, or all in one row of packed columns."""
    if not len(ids):
        return
    if packed:
        cols = (ids.astype(np.int64), prints.astype(np.uint32), start.astype(np.int32), end.astype(np.int32))
        yield pa.record_batch([[0], [1], *([c.tobytes()] for c in cols), [None], [None]], schema=_PACK_ARROW)
        return
    order = np.lexsort((start, prints, ids))
    ids, prints, pairs = ids[order], prints[order], np.stack([start[order], end[order]], 1).astype(np.int32)
    at = np.flatnonzero(A.firsts(ids, prints))
    stop = np.append(at[1:], len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(prints[at].astype(np.int64), pa.int64()), pa.array([pairs[i:j].tobytes() for i, j in zip(at, stop, strict=True)], pa.binary())], schema=_SPANS_ARROW)
