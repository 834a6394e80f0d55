"""Vector code compression: a codebook for each part of the vectors, by Yinyang Lloyd rounds on whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frozen, give_back

#: Parts of a vector, entries of a part's codebook, groups of entries, rounds before the last assignment, and units of 1.
PARTS, ENTRIES, GROUPS, ROUNDS, UNITS = 16, 64, 8, 2, 256
#: Sums travel as digits of so many bits, so that sums of any numbers fit 64 bits.
LIMB = 40
#: Rows that a task works on at once.
ROWS = 8192
#: Whole numbers below this keep all sums of squares exact in 64 bits (parts of up to 256 components).
EXACT = 1 << 27
#: A bound gives way by this share, so that rounding never makes it too large.
SLACK = 1e-5


def floors(x: np.ndarray) -> np.ndarray:
    """floor(UNITS * x), as 64-bit integers where all are below EXACT, else as Python's."""
    scaled = np.floor(np.asarray(x, np.float64) * UNITS)
    if scaled.size and np.abs(scaled).max() >= EXACT:
        return np.array([[int(v) if np.isfinite(v) else int(np.float64(o)) * UNITS for v, o in zip(a, b, strict=True)] for a, b in zip(scaled.tolist(), np.asarray(x).tolist(), strict=True)], object)
    return scaled.astype(np.int64)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows from entries, exact: through one matrix product where doubles hold every sum."""
    if x.dtype == object or entries.dtype == object:
        return ((x.astype(object)[:, None, :] - entries.astype(object)[None, :, :]) ** 2).sum(2)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * most * most < 1 << 50:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def root(d: np.ndarray, up: bool = False) -> np.ndarray:
    """Square roots as doubles; of Python's numbers those of the next whole root below, or above."""
    if d.dtype != object:
        return np.sqrt(d.astype(np.float64))
    return np.array([float(math.isqrt(x) + up) for x in d.reshape(-1)]).reshape(d.shape)


def grouped(entries: np.ndarray) -> np.ndarray:
    """Each entry's group: a few Lloyd steps on the entries themselves, from evenly spaced ones."""
    x = entries.astype(np.float64) / max(1, np.abs(entries).max())
    centres = x[np.linspace(0, len(x) - 1, min(GROUPS, len(x))).astype(int)]
    for _ in range(5):
        of = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([x[of == g].mean(0) if (of == g).any() else c for g, c in enumerate(centres)])
    return of


def assign(x: np.ndarray, book: np.ndarray, groups: np.ndarray, code: np.ndarray | None, bound: np.ndarray | None, drift: np.ndarray | None, counts: np.ndarray | None = None):
    """(code, squared distance, bounds) of each row: its nearest entry, ties to the lower index, and under the distance of every other entry, group by group.

    The first time all is scanned. Later a row's own entry is measured exactly, each group's bound falls by the most that an
    entry of the group moved, and only groups whose bound is not over the own distance are scanned, in whole numbers.
    counts, if given, gets [distances measured, distances of a full scan].
    """
    n, kinds = len(x), int(groups.max()) + 1
    new_bound = np.full((n, kinds), np.inf)
    if code is None:
        d = squared(x, book)
        code = d.argmin(1)
        own = d[np.arange(n), code]
        masked = root(d)
        masked[np.arange(n), code] = np.inf
        for g in range(kinds):
            new_bound[:, g] = masked[:, groups == g].min(1, initial=np.inf)
        if counts is not None:
            counts += [d.size, d.size]
        return code, own, new_bound * (1 - SLACK)
    moved = np.array([drift[groups == g].max(initial=0) for g in range(kinds)])
    low = bound - moved[None, :] * (1 + SLACK)
    first = code.copy()
    own = squared_rows(x, book[code])
    first_own = own.copy()
    reach = root(own, True) * (1 + SLACK)
    measured = n
    best, best_d = code.copy(), own.copy()
    scanned: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(kinds):
        rows, members = np.flatnonzero(low[:, g] <= reach), np.flatnonzero(groups == g)
        new_bound[:, g] = np.maximum(low[:, g], 0)
        if not len(rows) or not len(members):
            continue
        d = squared(x[rows], book[members])
        measured += d.size
        at = d.argmin(1)
        near, near_d = members[at], d[np.arange(len(rows)), at]
        better = (near_d < best_d[rows]) | ((near_d == best_d[rows]) & (near < best[rows]))
        best[rows[better]], best_d[rows[better]] = near[better], near_d[better]
        scanned.append((g, rows, members, d))
    for g, rows, members, d in scanned:
        far = root(d)
        far[members[None, :] == best[rows][:, None]] = np.inf
        new_bound[rows, g] = far.min(1) * (1 - SLACK)
    # an entry that a row has left is now one of its group's others
    left = np.flatnonzero(best != first)
    g = groups[first[left]]
    new_bound[left, g] = np.minimum(new_bound[left, g], root(first_own[left]) * (1 - SLACK))
    if counts is not None:
        counts += [measured, n * len(book)]
    return best, best_d, new_bound


def squared_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(1)


def _valid(rows: DataFrame) -> DataFrame:
    """Rows whose vector is there and finite throughout."""
    return rows.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row of (vec_id, embedding, label) whose vector is finite.

    Components become floor(256 x). A vector has `parts` equal parts, each with a codebook that starts from the rows with
    the least ids; a round assigns every part to its nearest entry and moves each entry to the floor of its parts' mean.
    code: two hex digits a part. error: squared distances added up. label_error: error added up over equal labels.

    Rows stay where they are read: a round shuffles one partial sum for each task, entry and component, and the driver holds
    the codebooks alone (entries x the vector's length, whatever the number of rows). Codes and bounds of a round lie in
    a table in the shared folder, so a lost executor repeats only its own tasks.

    Of equal ids the vector that comes first in order starts a codebook; null ids come last; repeated rows count as often as
    they come; with fewer rows than entries a codebook is smaller. Vectors as long as that of the least id take part; others,
    and all if that length is 0 or no multiple of the parts, have null code and error. Errors beyond 64 bits are shown
    as the largest number. Null labels are one label. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    data = frozen(_valid(vectors.select("vec_id", F.col("embedding").alias("v"), "label")))
    start = data.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    if not start:
        return data.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    length = len(start[0].v)
    if not length or length % parts:
        return data.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    side = length // parts
    books = floors(np.array([r.v for r in start if len(r.v) == length])).reshape(-1, parts, side).transpose(1, 0, 2)
    if len(books[0]) < len(start):  # rows of another length have no say: take the least ids among the others
        start = data.filter(F.size("v") == length).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
        books = floors(np.array([r.v for r in start])).reshape(-1, parts, side).transpose(1, 0, 2)
    groups = np.stack([grouped(b) for b in books])
    drift, most = None, 2**63 - 1

    def whole(v) -> np.ndarray:
        return floors(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), length)).reshape(len(v), parts, side)

    def assigned(rows: DataFrame, books: np.ndarray, drift: np.ndarray | None, last: bool) -> DataFrame:
        kinds = [int(g.max()) + 1 for g in groups]
        edge = np.concatenate([[0], np.cumsum(kinds)])

        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    v = part.column("v")
                    x = whole(v)
                    old = None if drift is None else np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(v), parts)
                    low = None if drift is None else np.frombuffer(b"".join(part.column("bounds").to_pylist()), np.float32).reshape(len(v), -1)
                    code, bounds, error = np.zeros((len(v), parts), np.uint8), np.zeros((len(v), edge[-1]), np.float32), np.zeros(len(v), object if x.dtype == object else np.int64)
                    for p in range(parts):
                        at = slice(edge[p], edge[p + 1])
                        c, d, b = assign(x[:, p], books[p], groups[p], None if old is None else old[:, p].astype(np.int64), None if low is None else low[:, at].astype(np.float64), None if drift is None else drift[p])
                        code[:, p], bounds[:, at] = c, np.minimum(b, 3e38)  # what 32 bits hold
                        error = error + d
                    out = [part.column("vec_id"), part.column("label"), v, pa.array([r.tobytes() for r in code]), pa.array([min(int(e), most) for e in error], pa.int64())]
                    if not last:
                        out.append(pa.array([r.tobytes() for r in bounds]))
                    yield pa.RecordBatch.from_arrays(out, names=["vec_id", "label", "v", "code", "error", "bounds"][: len(out)])
            give_back()

        kinds_of = dict(data.dtypes)
        return rows.mapInArrow(run, f"vec_id {kinds_of['vec_id']}, label {kinds_of['label']}, v {kinds_of['v']}, code binary, error long" + ("" if last else ", bounds binary"))

    def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
        """Each entry's new place: one partial sum for each task, entry and component."""
        def run(batches):
            total, count = np.zeros((parts, books.shape[1], side), np.int64), np.zeros((parts, books.shape[1]), np.int64)
            for batch in batches:
                v = batch.column("v")
                x = whole(v)
                if x.dtype == object:
                    total = total.astype(object)
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(v), parts)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], x[:, p])
                    count[p] += np.bincount(code[:, p], minlength=books.shape[1])
            some = np.repeat(count.reshape(-1), side)
            told = [(at, -1, int(some[at])) for at in np.flatnonzero(some).tolist()]
            for at, _, _ in list(told):
                t = int(total.reshape(-1)[at])
                sign, t, limb = (1, t, 0) if t > 0 else (-1, -t, 0)
                while t:
                    told.append((at, limb, sign * (t & (1 << LIMB) - 1)))
                    t, limb = t >> LIMB, limb + 1
            if told:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*told, strict=True)], names=["at", "limb", "sum"])

        found = rows.select("v", "code").mapInArrow(run, "at long, limb long, sum long").groupBy("at", "limb").agg(F.sum("sum").alias("sum"))
        totals, counts = {}, {}
        for r in found.collect():  # a few rows for each entry and component
            if r.limb < 0:
                counts[r.at] = r.sum
            else:
                totals[r.at] = totals.get(r.at, 0) + (r.sum << LIMB * r.limb)
        out = books.astype(object).reshape(-1)
        for at, n in counts.items():
            out[at] = totals.get(at, 0) // n
        out = out.reshape(books.shape)
        return out.astype(np.int64) if max(map(abs, out.reshape(-1))) < EXACT else out

    rows = data.filter(F.size("v") == length)
    for _ in range(rounds):
        rows = frozen(assigned(rows, books, drift, False))
        new = moved(rows, books)
        drift = root(((new - books) ** 2).sum(2), True)
        books = new
    done = assigned(rows, books, drift, True).select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error")
    done = frozen(done.unionByName(data.filter(F.size("v") != length).select("vec_id", "label"), allowMissingColumns=True))
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()
    sums = done.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("all"))
    both = done.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "code", "error", F.least(F.col("all"), F.lit(most).cast("decimal(38,0)")).cast("long").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
