"""Language-model scoring with a log-frequency Bloom filter."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import bloom
from .arrays import U
from .shared import chunks, frozen, partitions, string_buffers

END = U(0xE2D00000000000E2)
START = U(0x57A27000000057A2)
#: Bits of the filter for each rung, at least: with 4 probes a rung that was not set is read as set in 1.2 % of cases or fewer.
RUNG_BITS = 10
_SHAPE = "chunk long, part int, kind int, keys binary, counts binary"
_NAMES = ["chunk", "part", "kind", "keys", "counts"]


def _tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts (A-Z lower-cased words, then END) and the first token's index of each text."""
    low = A.LOWER[raw]
    starts, ends, first = A.words(low, off)
    out = np.insert(A.word_hashes(low, starts, ends), first[1:], END)
    return out, first + np.arange(len(first))


def _pairs(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it (START at a text's first)."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = START
    return A.mix(before * U(0x9FB21C651E98DF25) + tokens), before


def _packed(chunk: int, kind: int, keys: np.ndarray, counts: np.ndarray):
    part = (keys >> U(54)).astype(np.int64)  # keys are sorted
    at = np.flatnonzero(A.firsts(part))
    end = np.append(at[1:], len(part))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk)), pa.array(part[at], pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), pa.array([keys[i:j].tobytes() for i, j in zip(at, end, strict=True)], pa.binary()), pa.array([counts[i:j].astype(np.uint32).tobytes() for i, j in zip(at, end, strict=True)], pa.binary())], names=_NAMES)


def level(n: np.ndarray) -> np.ndarray:
    """Quantised count: 1 for 1, then two more for each doubling."""
    return 1 + np.floor(2 * np.log2(n) + 1e-9).astype(np.int64)


def least_of(levels):
    """The least count of a level."""
    return np.ceil(2.0 ** ((levels - 1) / 2) - 1e-9)


def _value(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its counts; 0 for level 0."""
    low = least_of(levels)
    return np.where(levels > 0, (low + np.maximum(low, least_of(levels + 1) - 1)) / 2, 0.0)


def _rung(keys: np.ndarray, j: int) -> np.ndarray:
    """A key's j-th rung, in segment 0: each part of the keys has a filter of its own."""
    return A.mix(keys + U(j * 0xD6E8FEB86659FD93 % 2**64)) >> U(bloom.SEGMENT_BITS)


def levels(keys: np.ndarray, filled: np.ndarray, bits: int) -> np.ndarray:
    """A key's level: how many of its rungs the filter holds, from the first to the first missing one."""
    out, live, j = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
    while len(live) and j < 128:
        live = live[bloom.has(_rung(keys[live], j), bits, filled)]
        out[live] = j
        j += 1
    return out


def read_levels(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Levels of distinct keys met n times (0 or more), read off a log-frequency Bloom filter that holds their rungs and grows with them."""
    up = np.zeros(len(keys), np.int64)
    up[n > 0] = level(n[n > 0])
    if not up.any():
        return up
    bits = bloom.bits_for(int(up.sum()) << bloom.SEGMENT_BITS, RUNG_BITS, 1 << 62)
    rungs = np.concatenate([_rung(keys[up >= j], j) for j in range(1, int(up.max()) + 1)])
    (_, filled), *_ = bloom.segments(rungs, bits)
    return levels(keys, np.frombuffer(filled, np.uint8), bits)


def answers(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """What chunks of docs (row, text, learn) meet, from one shuffle of their keys.

    kind 0 (tokens), 1 (pairs): of a chunk's distinct keys in a part, in order, the levels (counts). kind 2, 3: of a part's
    trained tokens and pairs the counts; keys for tokens only.
    """

    def ask(batches):
        for batch, lo, hi, raw, off in chunks(batches, chunk_bytes):
            tokens, first = _tokens(raw, off)
            learn = np.repeat(batch.column("learn").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(float), np.diff(first))
            for kind, keys in ((0, tokens), (1, _pairs(tokens, first)[0])):
                one, back = np.unique(keys, return_inverse=True)
                yield _packed(batch.column("row")[lo].as_py(), kind, one, np.bincount(back, weights=learn, minlength=len(one)))

    def tell(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for chunk, part, kind, k, c in zip(*(batch.column(x).to_pylist() for x in _NAMES), strict=True):
                held.setdefault((kind, part), []).append((chunk, k, c))
        for kind, part in sorted(held):
            rows = held.pop((kind, part))
            one, back = np.unique(np.frombuffer(b"".join(k for _, k, _ in rows), np.uint64), return_inverse=True)
            n = np.bincount(back, weights=np.frombuffer(b"".join(c for *_, c in rows), np.uint32), minlength=len(one)).astype(np.int64)
            said = read_levels(one, n).astype(np.uint8)[back]
            cut = np.cumsum([0, *(len(k) // 8 for _, k, _ in rows)])
            got = [(chunk, part, kind, None, said[a:b].tobytes()) for (chunk, _, _), a, b in zip(rows, cut[:-1], cut[1:], strict=True)]
            got.append((None, part, kind + 2, None if kind else one[n > 0].tobytes(), n[n > 0].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=_NAMES)

    return docs.mapInArrow(ask, _SHAPE).repartition(partitions(docs.sparkSession), "part").mapInArrow(tell, _SHAPE)


def score(docs: DataFrame, train_on, most_head: int = 1 << 20, chunk_bytes: int = 3 << 20) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score. train_on: which rows to learn from.

    Tokens: words with A-Z lower-cased, then one end. base_score is the add-one unigram log10 probability with exact
    counts: counts of the most frequent tokens (at most most_head, by a bound on counts) reach all workers, those of rarer tokens
    meet their documents in a join. score is the log10 probability under a pair model: a * c(h, w) / c(h) + (1 - a) * p(w),
    where every count is read off a log-frequency Bloom filter by probing its rungs, p(w) smooths w's own count by add-one,
    and a is the share of trained tokens whose pair is met again. The filter holds all tokens and pairs of training. It lies
    in parts, each sized by its own rungs, so its error rate stays the same at any size; no worker gets more than one part
    at once: keys go to their part, levels come back to the texts' chunk. Chunks are named by their first row's number, so docs
    must give the same rows in the same order when read again. A null text is one end; null and
    repeated ids are rows like any other; with nothing to learn from c is 0 throughout; an empty table gives no rows.
    """
    spark = docs.sparkSession
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train_on, F.lit(False)).alias("learn"))
    table = frozen(answers(numbered, chunk_bytes))
    singles = table.filter("kind = 2")

    def summary(batches):
        keys, tokens, again, by = 0, 0, 0, np.zeros(128, np.int64)
        for batch in batches:
            for kind, c in zip(batch.column("kind").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n = np.frombuffer(c, np.int64)
                if kind == 2:
                    keys, tokens = keys + len(n), tokens + int(n.sum())
                    by += np.bincount(level(n), minlength=128)
                else:
                    again += int((n - 1).sum())
        yield pa.record_batch([[keys], [tokens], [again], [by.tolist()]], names=["v", "n", "again", "by"])

    rows = table.filter("kind >= 2").select("kind", "counts").mapInArrow(summary, "v long, n long, again long, by array<long>").collect()
    v, n, again = (sum(r[k] for r in rows) for k in ("v", "n", "again"))
    by = np.sum([r["by"] for r in rows], 0) if rows else np.zeros(128, np.int64)
    least = next((int(least_of(k)) for k in range(1, 128) if by[k:].sum() <= most_head), 1)

    def frequent(batches):
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keys, m = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
                yield pa.record_batch([[keys[m >= least].tobytes()], [m[m >= least].tobytes()]], names=["k", "c"])

    got = singles.select("keys", "counts").mapInArrow(frequent, "k binary, c binary").collect()
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["k"], np.uint64) for r in got)])
    order = np.argsort(keys)
    head = spark.sparkContext.broadcast((keys[order], np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["c"], np.int64) for r in got)])[order]))
    floor = math.log10(n + v + 1)
    share = again / max(1, n)  # how often a trained token's pair is met elsewhere too: the weight of pair counts

    def texts(batches):
        """Each chunk's rows as a compressed Arrow stream."""
        for batch, lo, hi, _, _ in chunks(batches, chunk_bytes):
            part, sink = batch.slice(lo, hi - lo), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column("row")[lo].as_py()]), pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.nulls(1, pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=_NAMES)

    def read(table):
        """Per document what the head and the levels tell; and per rarer token (key, row, times)."""
        known, m = head.value
        table = table.sort_by([("kind", "ascending"), ("part", "ascending")])
        kinds, said = table.column("kind").to_numpy(), table.column("counts").to_pylist()
        batch = pa.Table.from_batches(pa.ipc.open_stream(said[0])).combine_chunks().to_batches()[0]
        one_level, two_level = (np.frombuffer(b"".join(x for x, k in zip(said, kinds, strict=True) if k == kind), np.uint8).astype(np.int64) for kind in (0, 1))
        raw, off = string_buffers(batch.column("text"))
        size_of = len(batch)
        tokens, first = _tokens(raw[off[0] : off[-1]], off - off[0])
        doc = np.repeat(np.arange(size_of), np.diff(first))
        one, back = np.unique(tokens, return_inverse=True)
        at = np.minimum(np.searchsorted(known, one), max(0, len(known) - 1))
        found = known[at] == one if len(known) else np.zeros(len(one), bool)
        c = np.where(found, m[at] if len(known) else 0, 0)
        two, where = np.unique(_pairs(tokens, first)[0], return_inverse=True)
        if (len(one), len(two)) != (len(one_level), len(two_level)):
            raise ValueError("docs gave other rows when read again")
        own, follow = _value(one_level), _value(two_level)[where]
        before = own[np.roll(back, 1)]
        before[first[:-1]] = own[np.searchsorted(one, END)]  # a text's first pair has START before it, as often as there are trained texts
        alone = np.minimum(1.0, (own[back] + 1) / (n + v + 1))
        p = np.where(before > 0, share * np.minimum(1.0, follow / np.maximum(before, 1)) + (1 - share) * alone, alone)
        logs = np.log10(c + 1.0)[back]
        sums = lambda x: np.bincount(doc, weights=x, minlength=size_of)
        rare = np.flatnonzero(~found[back])
        pair, times = np.unique(np.stack([doc[rare].astype(np.uint64), tokens[rare]]), axis=1, return_counts=True)
        cut = np.searchsorted(pair[0], np.arange(size_of + 1).astype(np.uint64))
        rares = [pair[1][a:b].astype(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.Table.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(np.diff(first)), pa.array(sums(found[back].astype(float)).astype(np.int64)), pa.array(sums(logs)), pa.array(sums(np.log10(p))), pa.array(rares, pa.list_(pa.int64())), pa.array([times[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64()))], names=["row", "doc_id", "n_tokens", "known", "logs", "score", "rare", "times"])

    def rare_counts(batches):
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                keys, m = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
                yield pa.record_batch([pa.array(keys[m < least].astype(np.int64)), pa.array(m[m < least])], names=["key", "c"])

    both = numbered.mapInArrow(texts, _SHAPE).unionByName(table.filter("kind < 2"))
    told = frozen(both.groupBy("chunk").applyInArrow(read, "row long, doc_id long, n_tokens long, known long, logs double, score double, rare array<long>, times array<long>"))
    asked = told.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    rest = asked.join(singles.select("keys", "counts").mapInArrow(rare_counts, "key long, c long"), "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("extra"))
    zero = F.lit(0).cast("long")
    return told.drop("rare", "times").join(rest, "row", "left").select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", zero)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("logs") + F.coalesce("extra", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score")


def held_out(doc_id: str):
    """Whether crc32 of the id's decimal text leaves 2 modulo 7 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def score_corpus(docs: DataFrame) -> DataFrame:
    """score() of all rows, learnt from those that are not held out, with held_out."""
    got = score(docs.select("doc_id", "text"), ~held_out("doc_id"))
    return got.withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
