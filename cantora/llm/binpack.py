"""Best-fit packing of whole documents by bin completion, branch and bound with best-fit solutions as incumbents."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frozen, give_back, partitions
from .tokens import encoder

END = (0).to_bytes(4, "little")
#: Pieces that one search packs, about.
GROUP = 1 << 14
#: Steps back that a search takes at most; one that ends there keeps its incumbent.
BACK = 400
#: Fillings of a node that branch, at most, and steps that look for them.
BRANCHES, LOOKS = 8, 300


def least_bins(count: np.ndarray) -> int:
    """No packing has fewer bins. count[s]: items of size s, up to the room, which is the last index.

    For every a up to half the room: items over room - a leave nothing that an item of a or more fits in; items over half
    the room each need a bin of their own; what the items from a to half the room have beyond the space left there fills more.
    """
    room = len(count) - 1
    many, mass = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * np.arange(room + 1)))
    half = room // 2
    best = -(-int(mass[-1]) // room)
    for a in range(half + 1):
        big, wide = int(many[-1] - many[room - a + 1]), int(many[room - a + 1] - many[half + 1])
        space = wide * room - int(mass[room - a + 1] - mass[half + 1])
        best = max(best, big + wide + max(0, -(-(int(mass[half + 1] - mass[a]) - space) // room)))
    return best


def best_fit(count: np.ndarray) -> list[list[int]]:
    """Bins (lists of sizes) of best-fit decreasing: the largest item left goes where the least space stays."""
    room = len(count) - 1
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(room + 1)]
    open_ = 0  # bit r: some bin has r left
    for s in range(room, 0, -1):
        for _ in range(int(count[s])):
            fits = open_ >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                b = by_space[r].pop()
                if not by_space[r]:
                    open_ ^= 1 << r
            else:
                r, b = room, len(bins)
                bins.append([])
            bins[b].append(s)
            by_space[r - s].append(b)
            open_ |= 1 << (r - s)
    return bins


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of filling b fit into those of filling a as if these were bins: then a is at least as good. Both are sorted, largest first."""
    if sum(b) > sum(a):
        return False
    space = list(a)

    def put(i: int) -> bool:
        if i == len(b):
            return True
        tried = set()
        for j, r in enumerate(space):
            if r >= b[i] and r not in tried:
                tried.add(r)
                space[j] -= b[i]
                if put(i + 1):
                    return True
                space[j] += b[i]
        return False

    return put(0)


def fillings(count: list[int], here: int, space: int, spare: int) -> list[tuple[int, ...]]:
    """Undominated fillings of `space` that waste at most `spare`, least waste first, then those of fewer, larger items.

    here has bit s set where count[s] > 0. An item that fills the space alone dominates all else.
    """
    if space and count[space]:
        return [(space,)]
    found: list[tuple[int, ...]] = []
    least = (here & -here).bit_length() - 1 if here else space + 1
    looks, exact = LOOKS, 0

    def look(space: int, top: int, chosen: tuple[int, ...]) -> None:
        nonlocal looks, exact
        size = (here & ((1 << (min(space, top) + 1)) - 1)).bit_length() - 1
        if size < 1 or space < least:
            # something larger would still fit: another branch has that filling
            fits = here & ((1 << (space + 1)) - 1)
            if space <= spare and not any(count[s] > chosen.count(s) for s in _sizes(fits)):
                found.append(chosen)
                exact += not space
            return
        while size > 0 and looks > 0 and exact < BRANCHES:
            looks -= 1
            if count[size] > chosen.count(size):
                look(space - size, size, (*chosen, size))
            size = (here & ((1 << size) - 1)).bit_length() - 1

    look(space, space, ())
    found = sorted(set(found), key=lambda f: (-sum(f), len(f), tuple(-s for s in f)))[: 4 * BRANCHES]
    out: list[tuple[int, ...]] = []
    for f in found:
        if not any(len(f) <= 8 and len(g) <= 8 and dominates(g, f) for g in out):
            out.append(f)
    return out[:BRANCHES]


def _sizes(bits: int):
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def complete(sizes: np.ndarray, room: int) -> list[list[int]]:
    """Bins (lists of sizes) of at most `room` that hold all sizes (1 to room), as few as the search finds.

    Best fit gives the first incumbent. While it is over least_bins, the search fills one bin after another, each around the
    largest item left with an undominated filling; a branch whose waste shows that it cannot beat the incumbent is cut.
    """
    count = np.bincount(sizes, minlength=room + 1)
    best, bound, total = best_fit(count), least_bins(count), int(sizes.sum())
    left, back = count.tolist(), BACK
    here = sum(1 << s for s in range(1, room + 1) if left[s])
    done: list[tuple[int, ...]] = []  # bins filled on the way to this node
    branches: list[list[tuple[int, ...]]] = []  # of each such bin, the fillings not tried yet
    waste = 0

    def take(f: tuple[int, ...], by: int) -> None:
        nonlocal here
        for s in f:
            left[s] += by
            here = here | 1 << s if left[s] else here & ~(1 << s)

    def options() -> list[tuple[int, ...]]:
        spare = (len(best) - 1) * room - total - waste
        if spare < 0 or not here:
            return []
        top = here.bit_length() - 1
        take((top,), -1)
        got = [(top, *f) for f in fillings(left, here, room - top, spare)]
        take((top,), 1)
        return got[::-1]

    if len(best) > bound:
        branches.append(options())
    while branches and len(best) > bound and back > 0:
        if not branches[-1] or waste > (len(best) - 1) * room - total:
            branches.pop()
            back -= 1
            if done:
                f = done.pop()
                waste -= room - sum(f)
                take(f, 1)
            continue
        f = branches[-1].pop()
        take(f, -1)
        waste += room - sum(f)
        done.append(f)
        if not here and len(done) < len(best):
            best = [list(x) for x in done]
        branches.append(options())
    return best


def document_pieces(docs: DataFrame, tokenizer: str, room: int = 2048) -> DataFrame:
    """Pieces of each document's ids (its tokens, then id 0): doc_id, piece, start, length, ids_crc32.

    A document of at most `room` ids is one piece; a longer one is cut into pieces of `room` ids, of which the first may be shorter.
    """
    names = ("doc_id", "start", "length", "ids_crc32")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in names[1:])])

    def cut(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                out: list[list] = [[] for _ in schema]
                for doc, packed in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    packed += END
                    n = len(packed) // 4
                    edges = [0, *range(n % room or room, n + 1, room)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        for to, x in zip(out, (doc, k, a, b - a, zlib.crc32(packed[4 * a : 4 * b])), strict=True):
                            to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(docs: DataFrame, tokenizer: str, room: int = 2048) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces of `room` ids are sequences of their own. The others are dealt by a hash of their number into groups of about
    GROUP pieces, whatever their document, and each group is packed by `complete`: sequences beyond what the total needs are
    one for a group at most, unless sizes forbid better or a search ends at its node limit. Pieces are numbered once, in a
    table in the shared folder, so a lost executor changes nothing. A null or empty text is one id (0); null and repeated
    doc_ids are rows like any other; a very long text is cut into full pieces; other columns are ignored; an empty table
    gives no rows.
    """
    pieces = frozen(document_pieces(docs, tokenizer, room).withColumn("row", F.monotonically_increasing_id()))
    spark, cols = docs.sparkSession, ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.filter(F.col("length") == room).select(*cols, (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter(F.col("length") < room)
    groups = max(1, round(rest.count() / GROUP))
    schema = pa.schema([(c, pa.int32() if c == "piece" else pa.int64()) for c in (*cols, "sequence_id", "offset")])

    def place(table):
        table = table.sort_by("row")
        group, sizes = table.column("group")[0].as_py(), table.column("length").to_numpy()
        order = np.argsort(sizes, kind="stable")
        next_, n = {int(s): int(i) for s, i in zip(*np.unique(sizes[order], return_index=True), strict=True)}, len(sizes)
        seq, off = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for w, items in enumerate(complete(sizes, room)):
            at = 0
            for s in items:
                i = order[next_[s]]
                next_[s] += 1
                seq[i], off[i] = 2 * ((group << 32) + w), at
                at += s
        return pa.Table.from_arrays([*(table.column(c) for c in cols), pa.array(seq), pa.array(off)], schema=schema)

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups).cast("long"))).repartition(partitions(spark), "group")
    return full.unionByName(dealt.groupBy("group").applyInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
