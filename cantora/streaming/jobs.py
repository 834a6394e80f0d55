"""Streaming forms of the job operators: deduplicated units, one-minute totals, session gaps, batches, lines in order, states that expire, breakers."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _timed(events: DataFrame, at: str, late: str) -> DataFrame:
    """A stream with its watermark on a time with zone, as Spark asks for; a batch as it is."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events


def once(events: DataFrame, key: str, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once while its first event is within the watermark."""
    return _timed(events, at, late).dropDuplicatesWithinWatermark([key])


def minutes(events: DataFrame, value: str, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Totals of one-minute windows; works on a batch too."""
    held = _timed(events, at, late)
    return held.groupBy(F.window(at, "1 minute")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("peak")).select(F.col("window.start").alias("start"), "n", "peak")


def sessions(beats: DataFrame, key: str, at: str = "ts", gap: str = "420 seconds", late: str = "1 hour") -> DataFrame:
    """Runs of heartbeats with no silence over the gap."""
    held = _timed(beats, at, late)
    return held.groupBy(key, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("beats")).select(key, F.col("session_window.start").alias("start"), "beats")


#: Hours that a job's waiting lines, and an ended job's state, are kept without news.
WAITING_H, ENDED_H = 24, 6
_HOUR = 3_600_000


class _Batches(StatefulProcessor):
    """Lines that wait for their batch are a list in the state store; the batch's number is a value beside it."""

    def __init__(self, most: int, room: float, trigger: float, wait_ms: int):
        self.rule, self.wait_ms = (most, room, trigger), wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "pos long, size double", ttlDurationMs=WAITING_H * _HOUR)
        self.number = handle.getValueState("number", "batch int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        most, room, trigger = self.rule
        held, last = list(self.waiting.get()), False
        batch = self.number.get()[0] if self.number.exists() else 0
        out, n, total = [], 0, 0.0

        def close():
            nonlocal batch, n, total
            out.append((key[0], batch, n, round(total, 9)))
            batch, n, total = batch + 1, 0, 0.0

        new = []
        for f in rows:
            new += [(int(p), float(s)) for p, s in zip(f["pos"], f["size"], strict=True)]
            last = last or bool(f["last"].any())
        open_: list[tuple] = []
        for x in held + sorted(new):
            if n and total + x[1] > room:
                close()
                open_.clear()
            n, total = n + 1, total + x[1]
            open_.append(x)
            if n >= most or total >= room * trigger:
                close()
                open_.clear()
        if last and n:
            close()
            open_.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if open_:
            self.waiting.put(open_)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        else:
            self.waiting.clear()
        self.number.update((batch,))
        if out:
            yield pd.DataFrame(out, columns=["key", "batch", "n", "total"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.waiting.get())
        batch = self.number.get()[0] if self.number.exists() else 0
        self.waiting.clear()
        if held:
            self.number.update((batch + 1,))
            yield pd.DataFrame([(key[0], batch, len(held), sum(s for _, s in held))], columns=["key", "batch", "n", "total"])

    def close(self) -> None:
        pass


class _InOrder(StatefulProcessor):
    """What came too early waits in a map by place; a value tells the next place."""

    def __init__(self, first: int):
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.early = handle.getMapState("early", "pos long", "value string", ttlDurationMs=WAITING_H * _HOUR)
        self.cursor = handle.getValueState("cursor", "pos long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self.cursor.get()[0] if self.cursor.exists() else self.first
        for f in rows:
            for p, v in zip(f["pos"], f["value"], strict=True):
                if p >= at:
                    self.early.updateValue((int(p),), (v,))
        out = []
        while self.early.containsKey((at,)):
            out.append((key[0], at, self.early.getValue((at,))[0]))
            self.early.removeKey((at,))
            at += 1
        self.cursor.update((at,))
        if out:
            yield pd.DataFrame(out, columns=["key", "pos", "value"])

    def close(self) -> None:
        pass


class _Statuses(StatefulProcessor):
    """The last state is a value; an ended job's goes by a timer, which tells."""

    def __init__(self, ended: tuple, ttl_ms: int):
        self.ended, self.ttl_ms = ended, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [s for f in rows for s in f["state"].tolist()][-1]
        before = self.last.get()[0] if self.last.exists() else None
        self.last.update((new,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if new in self.ended:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        if new != before:
            yield pd.DataFrame([(key[0], str(new), False)], columns=["key", "state", "gone"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        self.last.clear()
        yield pd.DataFrame([(key[0], last, True)], columns=["key", "state", "gone"])

    def close(self) -> None:
        pass


class _Breakers(StatefulProcessor):
    """Three values: blocked until, failures in a row, width."""

    def __init__(self, block_s: int, limit: int, pause_s: int, most: int):
        self.rule = block_s, limit, pause_s, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "until double, failed int, width int", ttlDurationMs=WAITING_H * _HOUR)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        block_s, limit, pause_s, most = self.rule
        until, failed, width = self.state.get() if self.state.exists() else (0.0, 0, most)
        out = []
        for t, good, no in sorted((t, bool(g), bool(n)) for f in rows for t, g, n in zip(f["at"], f["ok"], f["refused"], strict=True)):
            out.append((key[0], t, t < until, width))
            failed, width = (0, min(most, width * 2)) if good else (failed + 1, max(1, width // 2))
            until = max(until, t + block_s) if no else until
            if failed >= limit:
                until, failed = max(until, t + pause_s), 0
        self.state.update((float(until), int(failed), int(width)))
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "open", "width"])

    def close(self) -> None:
        pass


def _kept(rows: DataFrame, key: str, processor: StatefulProcessor, shape: str) -> DataFrame:
    """rows by key through a processor whose state lies in RocksDB, so that it is not bounded by memory."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(processor, f"key {kind}, {shape}", "Append", "ProcessingTime")


def batches(lines: DataFrame, key: str, pos: str, size: str, most: int = 16, room: float = 45.0, trigger: float = 0.75, wait_ms: int = 60_000, last: str | None = None) -> DataFrame:
    """key, batch, n, total of a stream of lines, by the rule of ledger.batches; lines come in order of pos. What waits is given out after wait_ms without a line, or with a line whose column `last` is true."""
    rows = lines.select(key, F.col(pos).cast("long").alias("pos"), F.col(size).cast("double").alias("size"), (F.col(last) if last else F.lit(False)).alias("last"))
    return _kept(rows, key, _Batches(most, room, trigger, wait_ms), "batch int, n int, total double").withColumnRenamed("key", key)


def in_order(lines: DataFrame, key: str, pos: str, value: str, first: int = 0) -> DataFrame:
    """key, pos, value of a stream of lines that end in any order: each is given out once all before it were. What waits is the state."""
    rows = lines.select(key, F.col(pos).cast("long").alias("pos"), F.col(value).cast("string").alias("value"))
    return _kept(rows, key, _InOrder(first), "pos long, value string").toDF(key, pos, value)


def statuses(events: DataFrame, key: str, state_col: str, ended: tuple = ("done", "error", "stopped"), ttl_ms: int = ENDED_H * _HOUR) -> DataFrame:
    """key, state, gone of a stream of job states: each change, and once more when an ended job's entry goes after ttl_ms. A job that runs never goes."""
    return _kept(events.select(key, F.col(state_col).alias("state")), key, _Statuses(ended, ttl_ms), "state string, gone boolean").toDF(key, "state", "gone")


def breakers(calls: DataFrame, key: str, at: str, ok: str, refused: str, block_s: int = 120, limit: int = 6, pause_s: int = 25, most: int = 6) -> DataFrame:
    """key, at, open, width of a stream of calls: a refusal opens the breaker for block_s, a run of `limit` failures for pause_s; a failure halves the width, a success doubles it."""
    rows = calls.select(key, F.col(at).cast("double").alias("at"), F.col(ok).alias("ok"), F.col(refused).alias("refused"))
    return _kept(rows, key, _Breakers(block_s, limit, pause_s, most), "at double, open boolean, width int").toDF(key, at, "open", "width")


def retried(run, retries: int = 2, base_s: float = 3.0, sleep=threading.Event().wait):
    """(result, attempts, last error) of a call on the driver, tried again after base_s, 2 base_s, ..."""
    error = None
    for attempt in range(1, retries + 2):
        try:
            return run(), attempt, None
        except Exception as e:  # whatever failed is the report
            error = e
            if attempt <= retries:
                sleep(base_s * attempt)
    return None, retries + 1, error


def run_until(query, cancelled: threading.Event, poll_s: float = 0.2) -> bool:
    """Lets a streaming query run until it ends (True) or is cancelled (False). Started again with the same checkpoint it goes on where it stopped."""
    while query.isActive:
        if cancelled.wait(poll_s):
            query.stop()
            return False
    return True
