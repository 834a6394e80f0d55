"""Job ledgers: counts by stage and status, resume and purge joins, gates, reports, queues, stalls, breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cantora.functions.greedy import added_groups


def counts(rows: DataFrame, stages: list[str]) -> DataFrame:
    """stage, status, n: a row's stage columns as rows, counted."""
    parts = ", ".join(f"'{s}', {s}" for s in stages)
    return rows.selectExpr(f"stack({len(stages)}, {parts}) AS (stage, status)").filter("status IS NOT NULL").groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"))


def stale(log: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Ledger rows whose key has no file."""
    return log.join(present.select(key).distinct(), key, "left_anti")


def gated(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key passed the stage before."""
    return rows.join(done.select(key).distinct(), key, "left_semi")


def resume(log: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Insert-if-absent: a key that the log has keeps its row whole, nulls too; new keys come in."""
    a, b = log.withColumn("_had", F.lit(True)).alias("a"), new.alias("b")
    took = lambda c: F.when(F.col("a._had"), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *map(took, fields))


def complete_groups(rows: DataFrame, group: str, ok: str) -> DataFrame:
    """Groups whose rows all pass, with their size."""
    return rows.groupBy(group).agg(F.bool_and(ok).alias("all_ok"), F.count(F.lit(1)).alias("n")).filter("all_ok").drop("all_ok")


def report(rows: DataFrame, group: str) -> DataFrame:
    """By group: rows, failures, rows tried more than once, and whether all passed. rows: ok boolean, attempts."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("attempts") > 1).alias("retried"), F.bool_and("ok").alias("passed"))


def latest(rows: DataFrame, key: str, at: str, fields: list[str]) -> DataFrame:
    """Keyed status with carry-forward: each field's latest value that is not null."""
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(at, c))).alias(c) for c in fields])


def running(rows: DataFrame, shelf: list[str], bucket: Column, order: list, measure: Column, name: str) -> DataFrame:
    """rows with the running sum of measure over a shelf's rows in order. bucket must not fall as the order goes on; a shelf's buckets are summed up first and
    rows are only sorted inside a bucket, so that no task sorts a whole shelf."""
    held = rows.withColumn("_bucket", bucket).withColumn("_m", measure)
    sums = held.groupBy(*shelf, "_bucket").agg(F.sum("_m").alias("_s"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(W.partitionBy(*shelf).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast(sums.schema["_s"].dataType)))
    own = F.sum("_m").over(W.partitionBy(*shelf, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    keys = [*shelf, "_bucket"]
    last = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    got = held.withColumn("_own", own).join(last, same)
    return got.withColumn(name, F.col("_before") + F.col("_own")).select(*rows.columns, name)


def queue_position(rows: DataFrame, queue: str, at: str, key: str) -> DataFrame:
    """rows with their place in the queue, in order of time."""
    return running(rows, [queue], F.date_trunc("hour", at), [at, key], F.lit(1), "position")


def stalls(beats: DataFrame, key: str, at: str, ident: str, seconds: int = 420) -> DataFrame:
    """Heartbeats followed by more than `seconds` of silence."""
    nxt = F.lead(at).over(W.partitionBy(key).orderBy(at, ident))
    return beats.withColumn("silence_s", (F.unix_micros(nxt.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6).filter(F.col("silence_s") > seconds)


def islands(rows: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """Runs of consecutive rows with a set flag: key, island, length, first and last place."""
    w = W.partitionBy(key).orderBy(*order)
    at = rows.withColumn("at", F.row_number().over(w))
    runs = at.filter(flag).withColumn("island", F.col("at") - F.row_number().over(w))
    return runs.groupBy(key, "island").agg(F.count(F.lit(1)).alias("length"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def merged_islands(rows: DataFrame, key: str, order: list[str], flag: str, gap: int, *measures: Column) -> DataFrame:
    """Runs of flagged rows, joined where at most gap + 1 rows lie between them: key, passage, length (with those rows), first and last place, and aggregates of the flagged rows."""
    w = W.partitionBy(key).orderBy(*order)
    at = rows.withColumn("at", F.row_number().over(w)).filter(flag)
    new = F.coalesce(F.col("at") - F.lag("at").over(w) > gap + 2, F.lit(True)).cast("int")
    runs = at.withColumn("passage", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(key, "passage").agg((F.max("at") - F.min("at") + 1).alias("length"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), *measures)


def batches(rows: DataFrame, key: str, order: list[str], size: str, most: int = 16, room: float = 45.0, trigger: float = 0.75) -> DataFrame:
    """Batches of at most `most` rows and `room` in size: a row that would not fit opens the next one, and a batch closes once it is full or
    has `trigger` of the room. key, and the batches' row counts and sums."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(*order, size))), lambda x: x[size])
    got = rows.groupBy(key).agg(items.alias("sizes")).select(key, F.posexplode(added_groups(F.col("sizes"), room, most, room * trigger)).alias("batch", "b"))
    return got.select(key, "batch", "b.n", F.bround("b.total", 4).alias("total"))


def young(cache: DataFrame, at: str, now, ttl_s: int) -> DataFrame:
    return cache.filter(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")) <= ttl_s * 1_000_000)


def evict(cache: DataFrame, shelf: list[str], at: str, key: str, now, ttl_s: int, size: Column, room) -> DataFrame:
    """Entries that stay: younger than ttl_s, and the newest whose sizes together fit the room (size 1: the newest `room`)."""
    newest = [F.desc(at), F.desc(key)]
    held = running(young(cache, at, now, ttl_s), shelf, -F.unix_seconds(F.date_trunc("hour", at).cast("timestamp")), newest, size, "_held")
    return held.filter(F.col("_held") <= room).drop("_held")


def probe(requests: DataFrame, cache: DataFrame, key: str, least: int = 600) -> DataFrame:
    """Requests with what the cache holds for their key: `hit`, and the engine that made it (`edge` where none is noted). Entries of `least` bytes or fewer do not count."""
    held = cache.filter(F.col("bytes") > least).groupBy(key).agg(F.max(F.coalesce(F.nullif(F.trim("engine"), F.lit("")), F.lit("edge"))).alias("engine")).withColumnRenamed(key, "_key")
    return requests.join(held, F.col(key) == F.col("_key"), "left").withColumn("hit", F.col("_key").isNotNull()).drop("_key")


def pivoted(rows: DataFrame, stages: list[str], statuses: list[str]) -> DataFrame:
    """stage, total (ledger rows) and one count a status."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    per = counts(rows, stages).groupBy("stage").pivot("status", statuses).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long"))
    return per.na.fill(0, statuses).crossJoin(F.broadcast(total))  # one row


def chapters(rows: DataFrame, chapter: str, cid: str) -> DataFrame:
    """Each chapter's chunk ids in order of the id."""
    return rows.groupBy(chapter).agg(F.sort_array(F.collect_list(cid)).alias("cids"))


def eta(progress: DataFrame, job: str, at: str, done: str, total: str) -> DataFrame:
    """progress with left_s, the seconds left at the pace since the first report of 60 or more done, and a note. Both are null while warming up (fewer than 60 done, 25 more
    done since, or 5 s since), when done, or with less than 45 s left."""
    w = W.partitionBy(job).orderBy(at, done).rowsBetween(W.unboundedPreceding, 0)
    warm = (F.col(done) >= 60) & (F.col(total) > F.col(done))
    first = F.min(F.when(warm, F.struct(F.col(at).alias("at"), F.col(done).alias("done")))).over(w)
    dt = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("_f.at").cast("timestamp"))) / 1e6
    dd = F.col(done) - F.col("_f.done")
    left = F.when(warm & (dd >= 25) & (dt >= 5), (F.col(total) - F.col(done)) * (dt / dd))
    got = progress.withColumn("_f", first).withColumn("left_s", F.when(left >= 45, left)).drop("_f")
    note = F.when(F.col("left_s") < 5400, F.format_string("about %d min left", F.greatest(F.lit(1), F.rint(F.col("left_s") / 60).cast("int")))).otherwise(F.format_string("about %.1f h left", F.col("left_s") / 3600))
    return got.withColumn("note", F.when(F.col("left_s").isNotNull(), note))


def first_of_kind(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Of each key the first row's fields: the first definition wins."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def first_success(tries: DataFrame, key: str, engine: str, ok: str, order: list[str]) -> DataFrame:
    """Of each request the engine that answered, the first in order whose try is ok, and the engines tried before it (all, if none is)."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(engine))
    best = F.min(F.when(F.col(ok), F.struct(place.alias("p"), F.col(engine).alias("e"))))
    all_ = F.array_sort(F.collect_set(F.struct(place.alias("p"), F.col(engine).alias("e"))))
    got = tries.filter(place > 0).groupBy(key).agg(best.alias("b"), all_.alias("t"))
    return got.select(key, F.col("b").isNotNull().alias("ok"), F.col("b.e").alias("engine"), F.transform(F.filter("t", lambda x: F.col("b").isNull() | (x["p"] < F.col("b.p"))), lambda x: x["e"]).alias("tried"))


#: Seconds between a job's attempts (the last one again and again), and how long it goes on.
WAITS, PATIENCE_S = (20, 30, 45, 60, 90, 120, 180, 300), 2700


def backoff(attempt: Column, waits: tuple = WAITS) -> Column:
    """Seconds to wait after an attempt (from 1)."""
    return F.element_at(F.array(*map(F.lit, waits)), F.least(attempt, F.lit(len(waits))).cast("int"))


def linear_backoff(attempt: Column, base: float = 3.0) -> Column:
    return base * attempt


def waited(attempt: Column, waits: tuple = WAITS) -> Column:
    """Seconds waited before an attempt (from 1) starts."""
    n = F.greatest(attempt - 1, F.lit(0)).cast("int")
    listed = F.aggregate(F.slice(F.array(*map(F.lit, waits)), F.lit(1), F.least(n, F.lit(len(waits)))), F.lit(0), lambda a, x: a + x)
    return listed + F.greatest(n - len(waits), F.lit(0)) * waits[-1]


def breaker(calls: DataFrame, key: str, at: str, ident: str, refused: str, block_s: int = 120) -> DataFrame:
    """calls with `open`: whether a refusal less than block_s earlier keeps the call from being made."""
    last = F.max(F.when(F.col(refused), F.unix_micros(F.col(at).cast("timestamp")))).over(W.partitionBy(key).orderBy(at, ident).rowsBetween(W.unboundedPreceding, -1))
    return calls.withColumn("open", F.coalesce(F.unix_micros(F.col(at).cast("timestamp")) - last < block_s * 1_000_000, F.lit(False)))


def width(groups: Column, most: int = 6, least: int = 1) -> Column:
    """Of a job's groups in order (array of booleans: whether all of the group failed) the width after each: halved by a failed group, doubled again by another."""
    zero = F.struct(F.lit(most).alias("w"), F.array().cast("array<int>").alias("all"))

    def step(a, failed):
        w = F.when(failed, F.greatest(F.lit(least), F.floor(a["w"] / 2).cast("int"))).otherwise(F.least(F.lit(most), a["w"] * 2))
        return F.struct(w.alias("w"), F.array_append(a["all"], w).alias("all"))

    return F.aggregate(groups, zero, step, lambda a: a["all"])


def pending(log: DataFrame, key: str, at: str, ident: str, state: str, ended: list[str]) -> DataFrame:
    """Jobs to take up again after a restart: the last state is none of the ended ones. With their place in line."""
    last = log.groupBy(key).agg(F.max_by(state, F.struct(at, ident)).alias("state"), F.min(at).alias("since"))
    return running(last.filter(~F.col("state").isin(ended)), [], F.date_trunc("hour", "since"), ["since", key], F.lit(1), "position")


def prefix_ready(lines: DataFrame, job: str, pos: str, ready: str) -> DataFrame:
    """The lines that may be written: those before a job's first line that is not ready."""
    gap = lines.groupBy(job).agg(F.min(F.when(~F.col(ready), F.col(pos))).alias("_gap")).withColumnRenamed(job, "_job")
    return lines.join(gap, F.col(job) == F.col("_job")).filter(F.col("_gap").isNull() | (F.col(pos) < F.col("_gap"))).drop("_gap", "_job")
