"""Suffix-array dedup of bytes by prefix doubling (see doubling)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .doubling import Doubling
from .repeats import merged, with_spans
from .shared import chunks


def suffix_dedup(docs: DataFrame, length: int = 100, start: int = 25, keep_text: bool = True, **options) -> DataFrame:
    """Each row of docs without the bytes covered by a run of `length` UTF-8 bytes that also starts earlier.

    Ranks of places start at `start` bytes and double until `length`; options are those of Doubling.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes) and, if asked
    for, kept (the remaining bytes; a cut may fall inside a character). A null text counts as empty; a null doc_id sorts
    first and stays null; rows that agree in doc_id and text do not remove each other; other columns are ignored; an
    empty table gives no rows.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("kept", pa.binary())] if keep_text else []
    schema = pa.schema(fields)

    def cut(batches):
        for batch, lo, hi, raw, off in chunks(batches, 4 << 20):
            doc_ids, data = batch.column("doc_id").slice(lo, hi - lo), raw.tobytes()
            out: list[list] = [[] for _ in fields[1:]]
            for i, spans in enumerate(batch.column("spans").slice(lo, hi - lo).to_pylist()):
                a, b = int(off[i]), int(off[i + 1])
                gone = merged(spans).tolist() if spans else []
                edges = [a, *(a + x for span in gone for x in span), b]
                kept = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                for to, x in zip(out, (b - a, b - a - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(x, t) for x, (_, t) in zip(out, fields[1:], strict=True))], schema=schema)

    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return with_spans(docs, Doubling(length, start, start, **options).spans(docs)).mapInArrow(cut, shape)
