"""Session helpers of the corpus operators: shared storage, Arrow chunks, partition counts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: doc_id of a row whose id is null, inside the array code only.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='cantora-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def frozen(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: later jobs see the same rows, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cantora-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Text that goes to a worker at once, in bytes, where the session does not say otherwise.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that long texts do not come ten thousand at a time; a value of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.sparkContext.getConf().toDebugString():
        spark.conf.set(key, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def string_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array without copying; a null is an empty text."""
    kind = np.int64 if "large" in str(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


#: What a worker keeps from task to task for one operator; it goes when the worker reads for another.
kept: dict = {}


def give_back() -> None:
    """Returns memory that a task has freed to the system: workers outlive their tasks, and the next stage shares the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batches, most: int):
    """Runs of rows of each record batch with about `most` bytes of text: (first row, end row, bytes, offsets from 0)."""
    kept.clear()
    give_back()
    for batch in batches:
        raw, off = string_buffers(batch.column("text"))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
            hi = min(hi, n)
            yield batch, lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi
    give_back()


def ids_of(batch, lo: int, hi: int, name: str = "doc_id") -> np.ndarray:
    col = batch.column(name).slice(lo, hi - lo)
    return (col.fill_null(NO_ID) if col.null_count else col).to_numpy(zero_copy_only=False).astype(np.int64)
