"""Substring dedup by words: seed and extend (see repeats)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .repeats import Repeats, merged, with_spans
from .shared import chunks, ids_of


def substring_dedup(docs: DataFrame, length: int = 20, seed: int = 8, keep_text: bool = True) -> DataFrame:
    """Each row of docs without the words covered by a window of `length` words that also starts earlier.

    Words are runs without [\\x20\\x09-\\x0D], unchanged. Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words
    joined by one space, UTF-8), spans (removed [start, end) runs in words) and, if asked for, the kept text.
    A null text counts as empty (0 words, the digest of nothing); a null doc_id sorts first and stays null; rows that
    agree in doc_id and text do not remove each other; other columns are ignored; an empty table gives no rows.
    """
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))]
    fields += [("text", pa.string())] if keep_text else []
    schema = pa.schema(fields)

    def cut(batches):
        for batch, lo, hi, raw, off in chunks(batches, 4 << 20):
            starts, ends, first = A.words(raw, off)
            doc_ids, data = batch.column("doc_id").slice(lo, hi - lo), raw.tobytes()
            out: list[list] = [[] for _ in fields[1:]]
            for i, spans in enumerate(batch.column("spans").slice(lo, hi - lo).to_pylist()):
                a, b = int(first[i]), int(first[i + 1])
                gone = merged(spans) if spans else np.zeros((0, 2), np.int64)
                keep = np.ones(b - a, bool)
                for s, e in gone:
                    keep[s:e] = False
                at = np.flatnonzero(keep) + a
                kept = b" ".join([data[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                for to, x in zip(out, (b - a, b - a - len(at), hashlib.sha256(kept).hexdigest(), gone.tolist(), kept.decode("utf-8", "replace")), strict=False):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(x, t) for x, (_, t) in zip(out, fields[1:], strict=True))], schema=schema)

    shape = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<int>>" + ", text string" * keep_text
    return with_spans(docs, Repeats("word", length, seed).spans(docs)).mapInArrow(cut, shape)
