"""Repeated runs of bytes by distributed prefix doubling.

The rank of a place is the name of its prefix's class: the first place, by (doc_id, start), where the same bytes start, told
by chunk and offset, so that rows that share an id (or have none) do not share names. A
chunk of documents lives under one number throughout; places are told by chunk and offset, and runs of places whose
names advance with them travel as one entry.

1. First ranks, by `start` bytes. Places of a window whose least seed (winnowing) is met once in all texts cannot repeat and
   are left out, by a Bloom filter. The others travel as stretches that share a least m-gram, with their bytes, so that
   equal prefixes meet in one part; there they are sorted, and each gets its class's name.
2. Doubling. With ranks by h bytes known, a place's pair (rank, rank at offset h) tells its prefix of 2h bytes. Pairs are
   sorted and named anew, until h reaches the length. Places whose prefix is met once drop out in each round, and those
   before them in the next.

A chunk sends each distinct entry once, with its first place, and copies the answer to the others, so bytes that a third
of all rows share meet in one part as often as there are chunks. Ranks are compared as 64-bit hashes; two unlike runs of
the final length could only pass for alike if all their parts did.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import bloom
from .arrays import U
from .repeats import _later, _prints, _span_rows, key_filter
from .shared import chunks, frozen, give_back, ids_of, partitions

_SHAPE = "`to` long, kind int, chunk long, data binary"
_SCHEMA = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary())])
#: Parts, at least.
PARTS = 512
#: Places of a part that are sorted at once, about.
AT_ONCE = 1 << 20
#: Kinds of entries: to a part, sent places; to a chunk, its documents, its places that share another's answer, and answers.
SENT, DOCS, SHARED, NAMED = range(4)
#: What is for a chunk goes to its number plus this; parts are numbered from 0.
CHUNKS = 1 << 62


_ZSTD = pa.Codec("zstd", compression_level=1)
_HEAD = struct.Struct("<q7i")


def _packed(cols: list[bytes]) -> bytes:
    """Up to seven columns behind their lengths, compressed together; not where that is no shorter."""
    data, sizes = b"".join(cols), [*map(len, cols), *[0] * (7 - len(cols))]
    small = _ZSTD.compress(data, asbytes=True) if len(data) > 64 else data
    return _HEAD.pack(len(data), *sizes) + small if len(small) < len(data) else _HEAD.pack(0, *sizes) + data


def _columns(rows, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """Columns of entries, one row's after another's; last how many the first column has from each row."""
    parts: list[list] = [[] for _ in kinds]
    for row in rows:
        data = row["data"]
        size, *sizes = _HEAD.unpack_from(data)
        data, at = _ZSTD.decompress(data[_HEAD.size :], size, asbytes=True) if size else data[_HEAD.size :], 0
        for part, n in zip(parts, sizes, strict=False):
            part.append(data[at : at + n])
            at += n
    return [*(np.frombuffer(b"".join(x), k) for x, k in zip(parts, kinds, strict=True)), np.array([len(x) for x in parts[0]]) // np.dtype(kinds[0]).itemsize]


def _entries(to: np.ndarray, kind: int, chunk, cols: list[np.ndarray]):
    """One row for each value of `to` (sorted); chunk is one number or goes with `to`."""
    if not len(to):
        return
    at = np.flatnonzero(A.firsts(to))
    end = np.append(at[1:], len(to))
    own = np.full(len(at), chunk) if np.ndim(chunk) == 0 else chunk[at]
    data = [_packed([c[i:j].tobytes() for c in cols]) for i, j in zip(at, end, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(to[at].astype(np.int64)), pa.array(np.full(len(at), kind, np.int32)), pa.array(own.astype(np.int64)), pa.array(data, pa.binary())], schema=_SCHEMA)


def _one(to: int, kind: int, chunk: int, cols: list[np.ndarray]):
    yield from _entries(np.zeros(1, np.int64) + to, kind, chunk, [np.frombuffer(c.tobytes(), np.uint8)[None] for c in cols])


def _grouped(batches):
    """(to, rows) of batches that are sorted by `to`."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["to"] != now and rows:
                yield now, rows
                rows = []
            now = row["to"]
            rows.append(row)
    if rows:
        yield now, rows


def _parts_and_rest(batches):
    """(rows of one part, None), and (None, batch) for what is not for parts. Batches are sorted by `to`."""
    now, rows = None, []
    for batch in batches:
        own = pc.equal(batch.column("kind"), SENT)
        if not all(own.to_pylist()):
            yield None, batch.filter(pc.invert(own))
            batch = batch.filter(own)
        for row in batch.to_pylist():
            if row["to"] != now and rows:
                yield rows, None
                rows = []
            now = row["to"]
            rows.append(row)
    if rows:
        yield rows, None


@dataclass(frozen=True)
class Doubling:
    """length, and start (bytes of the first ranks); seed of the winnowing; gram (m) that stretches share; chunk_bytes: text handled at once; filter_bits: most bits of the filter; part_seeds: seeds of a part, about; position_bits: see least_places."""

    length: int = 100
    start: int = 25
    seed: int = 25
    gram: int = 8
    chunk_bytes: int = (1 << 20) - (1 << 12)
    filter_bits: int = 1 << 28
    part_seeds: int = 1 << 17
    position_bits: int = 24

    def _seeds(self, raw: np.ndarray, off: np.ndarray):
        """Prefix sums; of each run of windows with one least seed: its hash, first and last window. None if no text is long enough."""
        n, size = len(raw), self.length
        lengths = np.diff(off)
        long = lengths >= size
        if not long.any():
            return None
        sums = A.prefix(A.BYTE[raw])
        seeds = A.every(sums, self.seed)
        live = np.zeros(n + 1, np.int32)
        live[off[:-1][long]] += 1
        live[off[1:][long] - size + 1] -= 1
        windows = np.flatnonzero(np.cumsum(live)[: n - size + 1])
        place = A.least_places(seeds, size - self.seed + 1, self.position_bits)[windows]
        new = np.flatnonzero(A.firsts(place))
        last = np.append(new[1:], len(windows)) - 1
        return sums, A.mix(seeds[place[new]] + U(0x51ED270B)), windows[new], windows[last]

    def _seed_task(self, parts: int):
        def run(batches):
            held, count = [], 0
            for _, _, _, raw, off in chunks(batches, self.chunk_bytes):
                got = self._seeds(raw, off)
                if got is not None:
                    ids, times = np.unique(got[1], return_counts=True)
                    held.append(np.concatenate([ids, ids[times > 1]]))
                    count += len(held[-1])
                if count >= 1 << 20:
                    yield from seeds_of(held)
                    held, count = [], 0
            if held:
                yield from seeds_of(held)

        def seeds_of(held):
            keys = np.sort(np.concatenate(held))
            yield from _entries((keys >> U(32)).astype(np.int64) * parts >> 32, SENT, 0, [keys])

        return run

    def _send(self, key, part, p, n, ids, at, extra, chunk: int):
        """Entries of one chunk: to parts the first of each key, with its cols of extra; to the chunk those that share its answer. extra(rows) gives the columns."""
        order = np.argsort(key)
        head = A.firsts(key[order])
        several = np.flatnonzero(~head | ~np.append(head[1:], True))
        order[several] = order[several][np.lexsort((at[order[several]], ids[order[several]], key[order[several]]))]
        head, later = _later(ids[order], at[order], key[order])
        first = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        many = np.zeros(len(first), bool)
        many[group[later]] = True
        own = order[first]
        share = np.flatnonzero(~head)
        if len(share):
            yield from _one(CHUNKS + chunk, SHARED, chunk, [p[order[share]].astype(np.int32), n[order[share]].astype(np.int32), p[own[group[share]]].astype(np.int32)])
        by = np.lexsort((p[own], part[own]))
        own, many = own[by], many[by]
        yield from _entries(part[own], SENT, chunk, [p[own].astype(np.int32), n[own].astype(np.int32), many.view(np.uint8), ids[own], at[own].astype(np.int32), *extra(own)])

    def _first_task(self, filled, bits: int, parts: int):
        def run(batches):
            base, serial = TaskContext.get().partitionId() << 32, 0
            for batch, lo, hi, raw, off in chunks(batches, self.chunk_bytes):
                got = self._seeds(raw, off)
                if got is None:
                    continue
                sums, seeds, s1, s2 = got
                hit = bloom.has(seeds, bits, filled.value)
                if not hit.any():
                    continue
                chunk, serial = base + serial, serial + 1
                ids, prints = ids_of(batch, lo, hi), _prints(raw, off)
                yield from _one(CHUNKS + chunk, DOCS, chunk, [off.astype(np.int64), ids, prints])
                n = len(raw)
                live = np.bincount(s1[hit], minlength=n + 1) - np.bincount(s2[hit] + self.length - self.start + 1, minlength=n + 1)
                at = np.flatnonzero(np.cumsum(live)[:n])
                grams = A.every(sums, self.gram)
                place = A.least_places(grams, self.start - self.gram + 1, self.position_bits)[at]
                first, size = A.runs(place, step=at)
                del seeds, s1, s2, hit
                # mixed again, as a least hash is a small one
                p, part = at[first], (A.mix(grams[place[first]]) >> U(32)).astype(np.int64) * parts >> 32
                doc = np.searchsorted(off, p, "right") - 1

                def text(own, p=p, size=size, raw=raw):
                    # bytes of each entry, in the order of entries: cut by entry in _entries through lengths
                    return [_Ragged(raw, p[own], size[own] + self.start - 1)]

                yield from self._send(A.ranges(sums, p, p + size + self.start - 1), part, p, size, ids[doc], p - off[doc], text, chunk)

        return run

    def _name_task(self, first: bool, last: bool):
        """Of the entries of a part, each place's name if its prefix is met again, back to its chunk. What is for chunks passes.

        A name is a place of the class's first document and start, told by chunk and offset, which no two rows share; after
        the last round it is (doc_id, start).
        """

        def run(batches):
            for rows, rest in _parts_and_rest(batches):
                if rest is not None:
                    yield rest
                    continue
                give_back()
                p, n, many, ids, at, *more, held = _columns(rows, ("i4", "i4", "u1", "i8", "i4", *(("u1",) if first else ("u8", "i4"))))
                chunks_, rank = np.unique(np.array([r["chunk"] for r in rows]), return_inverse=True)
                rank, many = np.repeat(rank.astype(np.int32), held), many.view(bool)
                rows.clear()
                if first:
                    yield from self._named(chunks_, rank, p, n, many, ids, at, self._prefixes(more[0], n), last)
                else:
                    yield from self._named_runs(chunks_, rank, p, n, many, ids, at, *more, last)

        return run

    def _prefixes(self, raw: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Hashes of the first `start` bytes of each place of entries with n places each."""
        size = (n + self.start - 1).astype(np.int64)
        end, out, lo, at = np.cumsum(size), np.empty(int(n.sum()), np.uint64), 0, 0
        while lo < len(n):  # some entries at a time: a byte takes many bytes here
            base = end[lo] - size[lo]
            hi = max(lo + 1, int(np.searchsorted(end, base + AT_ONCE, "right")))
            got = A.every(A.prefix(A.BYTE[raw[base : end[hi - 1]]]), self.start)[A.spread(end[lo:hi] - size[lo:hi] - base, n[lo:hi])]
            out[at : at + len(got)] = got
            lo, at = hi, at + len(got)
        return out

    def _named(self, chunks_, rank, p, n, many, ids, at, key, last):
        """Answers for entries, given each place's key; entries are in order of their place in their chunk.

        Keys are taken slice by slice, so that only a slice's places are sorted at once, however many share a part; only one key's places must be together.
        """
        before = np.cumsum(n, dtype=np.int64) - n
        own = np.repeat(np.arange(len(p), dtype=np.int32), n)
        slices = min(1 << (max(0, len(key) - 1) // AT_ONCE).bit_length(), 256)
        which = (A.mix(key) & U(slices - 1)).astype(np.uint8)
        name, begin = np.empty(len(key), np.int64), np.full(len(key), -1, np.int32)
        for k in range(slices):
            sel, names, begins = self._classes(np.flatnonzero(which == k), chunks_, rank, p, many, ids, at, key, own, before, last)
            name[sel], begin[sel] = names, begins
        del key, which
        met = np.flatnonzero(begin >= 0)
        for lo in range(0, len(met), AT_ONCE):
            sel = met[lo : lo + AT_ONCE]
            i, start = own[sel], begin[sel].astype(np.int64)
            to, place = chunks_[rank[i]], p[i] + (sel - before[i])
            k, length = A.runs(to, name[sel], start - place, step=place)
            yield from _entries(CHUNKS + to[k], NAMED, to[k], [place[k].astype(np.int32), length.astype(np.int32), name[sel][k], start[k].astype(np.int32)])

    def _classes(self, order, chunks_, rank, p, many, ids, at, key, own, before, last):
        """Of the places `order`, which hold all of their keys: those that are met again, and each one's name and begin."""
        key = key[order]
        by = np.argsort(key)
        order, key = order[by], key[by]
        same = key[1:] == key[:-1]
        met = many[own[order]]
        met[1:] |= same
        met[:-1] |= same
        order, key = order[met], key[met]
        if not len(order):
            return order, order, order
        start = np.flatnonzero(A.firsts(key))
        del by, key, same, met
        size = np.diff(np.append(start, len(order)))
        i = own[order]
        step = order - before[i]
        doc, here = ids[i], at[i] + step
        name = np.minimum.reduceat(doc, start)
        not_first = doc != np.repeat(name, size)
        begin = np.minimum.reduceat(np.where(not_first, np.int64(1) << 62, here), start)
        later = not_first | (here != np.repeat(begin, size))
        met = np.repeat(np.logical_or.reduceat(later | many[i], start), size)
        del doc, here, not_first
        if not last:
            head = rank[i].astype(np.int64)
            head <<= 32
            head += p[i]
            head += step
            head[later] = np.int64(2**63 - 1)
            del later
            head = np.minimum.reduceat(head, start)
            name, begin = chunks_[head >> 32], head & 0xFFFFFFFF
        return order[met], np.repeat(name, size)[met], np.repeat(begin, size)[met]

    def _named_runs(self, chunks_, rank, p, n, many, ids, at, line, x, last):
        """Answers for runs of places on lines: a run is named as a whole where all that meet it are the same; the others place by place."""
        order = np.lexsort((p, rank, at, ids, n, x, line))
        first = (np.cumsum(A.firsts(line[order])) - 1 << 32) + x[order]
        far = np.maximum.accumulate(first + n[order])
        new = np.ones(len(order), bool)
        new[1:] = first[1:] >= far[:-1]  # nothing before reaches it
        group = np.cumsum(new) - 1
        alike = A.firsts(line[order], x[order], n[order])
        plain = (np.bincount(group, weights=alike) == 1)[group]
        mixed = np.sort(order[~plain])
        if len(mixed):
            pn = n[mixed]
            own = np.repeat(mixed, pn)
            step = np.arange(len(own)) - np.repeat(np.cumsum(pn) - pn, pn)
            yield from self._named(chunks_, rank[mixed], p[mixed], pn, many[mixed], ids[mixed], at[mixed], A.mix(line[own] + (x[own] + step).astype(np.uint64) * U(0x9FB21C651E98DF25)), last)
        order, lead = order[plain], np.flatnonzero(A.firsts(group[plain]))
        if len(order):
            size = np.diff(np.append(lead, len(order)))
            head = np.repeat(order[lead], size)
            later = (ids[order] != ids[head]) | (at[order] != at[head])
            met = np.repeat(np.logical_or.reduceat(later | many[order], lead), size)
            order, head = order[met], head[met]
            by = np.lexsort((p[order], rank[order]))
            order, head = order[by], head[by]
            to, name, begin = chunks_[rank[order]], *((ids[head], at[head]) if last else (chunks_[rank[head]], p[head]))
            yield from _entries(CHUNKS + to, NAMED, to, [p[order].astype(np.int32), n[order].astype(np.int32), name, begin.astype(np.int32)])

    def _chunk_task(self, have: int, parts: int):
        """With names by `have` bytes: the pairs of the next round, or the spans of places that repeat an earlier one."""

        def run(batches):
            for to, rows in _grouped(batches):
                chunk = to - CHUNKS
                by = {k: [r for r in rows if r["kind"] == k] for k in (DOCS, SHARED, NAMED)}
                if not by[NAMED]:
                    continue
                off, ids, prints, _ = _columns(by[DOCS][:1], ("i8", "i8", "u4"))
                p, n, name, start, _ = _columns(by[NAMED], ("i4", "i4", "i8", "i4"))
                which = np.full(off[-1] + 1, -1, np.int32)  # each place's answer
                which[A.spread(p.astype(np.int64), n.astype(np.int64))] = np.repeat(np.arange(len(p), dtype=np.int32), n)
                moved = np.zeros(off[-1] + 1, np.int32)  # how far the answer's place is ahead
                if by[SHARED]:
                    sp, sn, sq = (x.astype(np.int64) for x in _columns(by[SHARED], ("i4", "i4", "i4"))[:3])
                    to, source = A.spread(sp, sn), A.spread(sq, sn)
                    which[to], moved[to] = which[source], source - to
                at = np.flatnonzero(which >= 0)
                doc = np.searchsorted(off, at, "right") - 1
                far = min(have, self.length - have)
                if far:
                    ok = at + far < off[doc + 1]
                    at, doc = at[ok], doc[ok]
                    ok = which[at + far] >= 0
                    at, doc = at[ok], doc[ok]

                def named(at):
                    w = which[at]
                    return name[w], start[w].astype(np.int64) + (at + moved[at] - p[w])

                one, x = named(at)
                if not far:
                    begin = at - off[doc]
                    again = (one != ids[doc]) | (x != begin)
                    doc, begin = doc[again], begin[again]
                    k, size = A.runs(doc, step=begin)
                    yield from _span_rows(ids[doc[k]], prints[doc[k]], begin[k], begin[k] + size - 1 + self.length, packed=False)
                    continue
                two, y = named(at + far)
                k, size = A.runs(one, two, x - at, y - at, doc, step=at)
                if not len(k):
                    continue
                yield from _one(CHUNKS + chunk, DOCS, chunk, [off, ids, prints])
                at, doc, x, one, two, gap = at[k], doc[k], x[k], one[k], two[k], (y - x)[k]
                line = A.mix(A.mix(one.view(np.uint64) * U(0x9E3779B97F4A7C15) + two.view(np.uint64)) + gap.view(np.uint64))
                key = A.mix(line + x.view(np.uint64) * U(0xD6E8FEB86659FD93) + size.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
                part = (line >> U(32)).astype(np.int64) * parts >> 32
                yield from self._send(key, part, at, size, ids[doc], at - off[doc], lambda own, line=line, x=x: [line[own], x[own].astype(np.int32)], chunk)

        return run

    def spans(self, docs: DataFrame) -> DataFrame:
        """(doc_id, fp, spans): for each row with repeats, its removed runs as packed int32 [start, end) pairs; a row may come several times."""
        spark, text = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text")
        n = partitions(spark)

        def repeated(batches):
            for _, rows in _grouped(batches):
                keys = np.sort(_columns(rows, ("u8",))[0])
                yield pa.record_batch([[np.unique(keys[1:][keys[1:] == keys[:-1]]).tobytes()], [len(keys)]], names=["keys", "n"])

        def dealt(entries):
            return entries.repartition(n, "to").sortWithinPartitions("to")

        # a part is worked on in one piece: one for each 64 MB of text, or for part_seeds of its seeds
        size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        seeds = frozen(dealt(text.mapInArrow(self._seed_task(max(PARTS, size >> 26)), _SHAPE)).mapInArrow(repeated, "keys binary, n long"))
        parts = max(PARTS, int(seeds.agg(F.sum("n")).first()[0] or 0) // self.part_seeds)
        entries, have = text.mapInArrow(self._first_task(*key_filter(seeds, "keys", self.filter_bits), parts), _SHAPE), self.start
        while have < self.length:
            names = dealt(entries).mapInArrow(self._name_task(have == self.start, False), _SHAPE)
            entries, have = dealt(names).mapInArrow(self._chunk_task(have, parts), _SHAPE), min(2 * have, self.length)
        names = dealt(entries).mapInArrow(self._name_task(have == self.start, True), _SHAPE)
        return dealt(names).mapInArrow(self._chunk_task(have, parts), "doc_id long, fp long, spans binary")


class _Ragged:
    """Runs of bytes, cut by run: c[i:j] are the bytes of runs i to j."""

    def __init__(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.raw, self.begin, self.size = raw, begin, size

    def __getitem__(self, runs: slice) -> np.ndarray:
        return self.raw[A.spread(self.begin[runs], self.size[runs])]
