"""Packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frozen, give_back, kept, partitions

END = (1).to_bytes(4, "little")
#: Pieces of a document's tail that one differencing run packs, about.
GROUP = 1200
#: One tail in CUT_EVERY is cut into grains, so that the last, smallest differences even the windows out.
CUT_EVERY, GRAIN = 6, 48
#: The split of byte-level BPE before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that the faster encoder's split, which goes back step by step there, is not given at a stretch.
LONG_BLANK = 1 << 16
#: How a tokenizer file is set up if SPLIT and its merges alone decide the ids.
_PLAIN = {"dropout": None, "unk_token": None, "continuing_subword_prefix": "", "end_of_word_suffix": "", "byte_fallback": False, "ignore_merges": False}


def _ranks(tokenizer) -> dict[bytes, int] | None:
    """Each token's bytes and id, if the tokenizer is plain byte-level BPE whose ids follow the order of its merges; else None."""
    setup = json.loads(tokenizer.to_str())
    model, before = setup["model"], setup["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and all((model.get(k) or v) == v for k, v in _PLAIN.items())
    if not plain or setup["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
        return None
    # printable bytes stand for themselves, the others for the characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = model["vocab"]
    order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if order != sorted(order) or not byte.keys() <= vocab.keys() or max(map(vocab.__getitem__, byte)) > min(order, default=1 << 32):
        return None
    return {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items()}


def _encoder(path: str):
    """encode(texts) -> each text's ids as little-endian unsigned 32-bit bytes; the string of an added token is that token.

    The ids are those of the tokenizer file. Where its merges alone decide them, a faster encoder with the same merges
    (tiktoken) computes them; else the tokenizers library itself does, as it does for texts that hold an added token's
    string or a run of LONG_BLANK white space characters.
    """
    if kept.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        kept.update(path=path, tok=tok, fast=None, added=[t.content for t in tok.get_added_tokens_decoder().values()])
        ranks = _ranks(tok)
        if ranks:
            import tiktoken

            # the other encoder is loaded again if a text asks for it
            kept.update(tok=None, fast=tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}))
        del tok, ranks
        give_back()
    fast, added = kept["fast"], kept["added"]
    blank = re.compile(rf"\s{{{LONG_BLANK}}}")

    def encode(texts):
        plain = [i for i, t in enumerate(texts) if not fast or any(a in t for a in added) or len(t) >= LONG_BLANK and blank.search(t)]
        if plain and kept["tok"] is None:
            from tokenizers import Tokenizer

            kept["tok"] = Tokenizer.from_file(path)
        said = dict(zip(plain, kept["tok"].encode_batch_fast([texts[i] for i in plain], add_special_tokens=False), strict=True)) if plain else {}
        return [np.array(said[i].ids if i in said else fast.encode_ordinary(t), "<u4").tobytes() for i, t in enumerate(texts)]

    return encode


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Items (their indices) of each of `windows` sets with nearly equal sums.

    Multiway differencing: each item starts as a partition with one filled set; the two partitions of the widest spread
    merge, the fullest set of one with the emptiest of the other, until one partition is left.
    """
    k = windows
    left, right, count = np.full(len(sizes) * (k + 1), -1), np.full(len(sizes) * (k + 1), -1), len(sizes)
    heap, states = [], {}
    for i, x in enumerate(sizes):
        sums, node = np.zeros(k, np.int64), np.full(k, -1)
        sums[0], node[0] = x, i
        states[i] = sums, node
        heap.append((-x, i))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, na), (sb, nb) = states.pop(a), states.pop(b)
        sums, other = sa + sb[::-1], nb[::-1]
        both = (na >= 0) & (other >= 0)
        node = np.where(na >= 0, na, other)
        new = np.arange(count, count + int(both.sum()))
        left[new], right[new] = na[both], other[both]
        node[both] = new
        count += len(new)
        order = np.argsort(-sums, kind="stable")
        sums, node = sums[order], node[order]
        states[serial] = sums - sums[-1], node
        heapq.heappush(heap, (int(sums[-1] - sums[0]), serial))
        serial += 1
    _, node = states[heap[0][1]]
    out = []
    for root in node.tolist():
        items, stack = [], [root] if root >= 0 else []
        while stack:
            x = stack.pop()
            if x < len(sizes):
                items.append(x)
            else:
                stack += [int(left[x]), int(right[x])]
        out.append(items)
    return out


def pack_group(sizes: list[int], room: int) -> list[list[int]]:
    """Windows of at most `room`: as few as the sum needs, and one more whenever the fullest is over its room."""
    total, windows = sum(sizes), max(1, -(-sum(sizes) // room))
    while True:
        got = differencing(sizes, windows) if windows < len(sizes) else [[i] for i in range(len(sizes))]
        if max(sum(sizes[i] for i in w) for w in got) <= room:
            return [w for w in got if w]
        windows += max(1, windows // 400)
        if windows >= total:
            windows = len(sizes)


def tokens(docs: DataFrame, tokenizer: str, room: int = 2048) -> DataFrame:
    """Pieces of each document's ids (its tokens, then END): doc_id, start, length, ids_crc32, doc_tokens. Full pieces have `room` ids; a tail is one piece, or grains."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])

    def cut(batches):
        encode = _encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids = part.column("doc_id").to_pylist()
                out: list[list] = [[] for _ in range(5)]
                for doc, packed in zip(ids, encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    packed += END
                    n = len(packed) // 4
                    edges = list(range(0, n, room))
                    tail = n - edges[-1]
                    if tail < room and zlib.crc32(packed[-4 * tail :]) % CUT_EVERY == 0:
                        edges += range(edges[-1] + GRAIN, n, GRAIN)
                    for a, b in zip(edges, [*edges[1:], n], strict=True):
                        for to, x in zip(out, (doc, a, b - a, zlib.crc32(packed[4 * a : 4 * b]), n), strict=True):
                            to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, room: int = 2048) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's full pieces are sequences of their own. Tails are dealt by row number into groups of about GROUP pieces,
    each packed by differencing into windows of at most `room` ids. Pieces are numbered once, in a table in the shared
    folder; a lost executor changes nothing. A null or empty text is one id (END); null and repeated doc_ids are rows like
    any other; a very long text is cut into full pieces; other columns are ignored; an empty table gives no rows.
    """
    pieces = frozen(tokens(docs, tokenizer, room).withColumn("row", F.monotonically_increasing_id()))
    spark, cols = docs.sparkSession, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = pieces.filter(F.col("length") == room).select(*cols, (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < room)
    groups = max(1, round(rest.count() / GROUP))
    schema = pa.schema([(c, pa.int64()) for c in (*cols, "sequence_id", "offset")])

    def place(table):
        table = table.sort_by("row")
        group, sizes = table.column("group")[0].as_py(), table.column("length").to_pylist()
        seq, off = [0] * len(sizes), [0] * len(sizes)
        for w, items in enumerate(pack_group(sizes, room)):
            at = 0
            for i in sorted(items):
                seq[i], off[i] = 2 * ((group << 32) + w), at
                at += sizes[i]
        return pa.Table.from_arrays([*(table.column(c) for c in cols), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], schema=schema)

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups).cast("long"))).repartition(partitions(spark), "group")
    return whole.unionByName(dealt.groupBy("group").applyInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
