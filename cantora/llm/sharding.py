"""Uniform sharding by a hypergeometric communication matrix, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import frozen

#: Rows of a block (a virtual input partition), about.
BLOCK_ROWS = 1 << 16
#: Most blocks; more rows make larger blocks.
MOST_BLOCKS = 1 << 16


def _draw(total: str, good: str, n: str, u: str) -> str:
    """SQL for one draw of the hypergeometric law: how many of n rows drawn from total are among good. Arguments are SQL for longs, and for u in [0, 1).

    The law's weights are summed outward from the mode (taken as 1), within 9 deviations, and u picks a place in that sum.
    """
    params = f"named_struct('t', {total}, 'g', {good}, 'n', {n}, 'u', {u})"
    lo, hi = "greatest(0L, p.n - (p.t - p.g))", "least(p.g, p.n)"
    mode = f"greatest({lo}, least({hi}, cast(floor((p.n + 1D) * (p.g + 1D) / (p.t + 2D)) as bigint)))"
    dev = "cast(ceil(9D * sqrt(greatest(0D, cast(p.n as double) * p.g / greatest(p.t, 1L) * (p.t - p.g) / greatest(p.t, 1L) * (p.t - p.n) / greatest(p.t - 1L, 1L)))) as bigint) + 12L"
    # q: the parameters with the support's window
    q = f"named_struct('t', p.t, 'g', p.g, 'n', p.n, 'u', p.u, 'm', {mode}, 'hi', least({hi}, {mode} + {dev}), 'lo', greatest({lo}, {mode} - {dev}))"
    ups = "if(q.hi > q.m, sequence(q.m + 1L, q.hi), cast(array() as array<bigint>))"
    downs = "if(q.lo < q.m, sequence(q.m, q.lo + 1L, -1L), cast(array() as array<bigint>))"
    # weight of x over that of x - 1, and the other way round
    up = "((q.g - x + 1D) * (q.n - x + 1D)) / (cast(x as double) * (q.t - q.g - q.n + cast(x as double)))"
    down = "(cast(x as double) * (q.t - q.g - q.n + cast(x as double))) / ((q.g - x + 1D) * (q.n - x + 1D))"
    total_of = lambda seq, ratio, start: f"aggregate({seq}, named_struct('w', 1D, 's', {start}), (a, x) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w * {ratio}), a -> a.s)"
    # r: with the weights' sums on either side and the place that u picks
    r = f"named_struct('q', q, 'up', {total_of(ups, up, '1D')}, 'down', {total_of(downs, down, '0D')})"
    qq = lambda s: s.replace("q.", "r.q.")
    find = lambda seq, ratio, first, w0, s0, at, step: f"aggregate({seq}, named_struct('w', 1D, 's', {s0}, 'v', {first}), (a, x) -> if(a.s > {at}, a, named_struct('w', a.w * {ratio}, 's', a.s + a.w * {ratio}, 'v', {step})), a -> a.v)"
    above = find(qq(ups), qq(up), "r.q.m", "1D", "1D", "r.q.u * (r.up + r.down)", "x")
    below = find(qq(downs), qq(down), "r.q.m", "1D", "0D", "(r.q.u * (r.up + r.down) - r.up)", "x - 1L")
    pick = f"if(r.q.u * (r.up + r.down) < r.up, {above}, {below})"
    return f"transform(array({params}), p -> transform(array({q}), q -> transform(array({r}), r -> {pick})[0])[0])[0]"


def _split(level: int, seed: int) -> str:
    """SQL: of each column's rows in a node of the tree, how many its left half of blocks gets. State: drawn counts, rows and places left."""
    draw = _draw("s.places", "caps[j]", "s.rows", f"shiftrightunsigned(xxhash64({seed}L, {level}L, lo, j), 11) * {2.0**-53!r}D")
    step = f"transform(array({draw}), k -> named_struct('got', array_append(s.got, k), 'rows', s.rows - k, 'places', s.places - caps[j]))[0]"
    return f"aggregate(sequence(0, size(caps) - 1), named_struct('got', cast(array() as array<bigint>), 'rows', left_rows, 'places', all_rows), (s, j) -> {step}, s -> s.got)"


def matrix(counts: DataFrame, caps: list[int], blocks: int, seed: int) -> DataFrame:
    """(block, caps): how many rows each block sends to each column, given its rows (block, n) and the columns' sizes.

    A tree over the blocks: a node's left half draws its share of each column's places from the multivariate
    hypergeometric law, one column after another; the right half gets the rest. Margins are exact at every node.
    """
    every = counts.sparkSession.range(blocks).join(counts, F.col("id") == F.col("block"), "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("id", "n"))), lambda x: x["n"])
    node = every.agg(rows.alias("ns")).select(F.lit(0).cast("long").alias("lo"), "ns", F.array(*[F.lit(c).cast("long") for c in caps]).alias("caps"))
    for level in range(blocks.bit_length() - 1):
        half = blocks >> (level + 1)
        total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
        node = node.withColumn("left_ns", F.slice("ns", 1, half)).withColumn("left_rows", total(F.col("left_ns"))).withColumn("all_rows", total(F.col("ns")))
        node = node.withColumn("got", F.expr(_split(level, seed)))
        left = F.struct(F.col("lo"), F.col("left_ns").alias("ns"), F.col("got").alias("caps"))
        right = F.struct((F.col("lo") + half).alias("lo"), F.slice("ns", half + 1, half).alias("ns"), F.zip_with("caps", "got", lambda a, b: a - b).alias("caps"))
        node = node.select(F.explode(F.array(left, right)).alias("c")).select("c.*")
        if level == 5:
            node = node.repartition("lo")
    return node.select(F.col("lo").alias("block"), "caps")


def shard(docs: DataFrame, shards: int = 40, seed: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each row's shard and slot under the law `rows`: shard sizes differ by one at most, every assignment is equally likely.

    A matrix says how many rows each block sends to each shard (see matrix). A block orders its rows by one hash and deals
    them out by its row of the matrix; a shard orders what it gets by another hash, in ranges, so that no task sorts a whole
    shard, and numbers its rows through. Returns doc_id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot (gapless
    from 0), grown_shard (null). A null text counts as empty (size 16, checksum 0); null and repeated doc_ids are rows like
    any other; other columns are ignored; an empty table gives no rows. Rows get a number once, in a table in the shared
    folder, so a lost executor changes nothing; blocks are drawn from that number, so no key can make a block or shard
    large. The matrix is a table of one row a block and is joined by block, where the rows are already.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = frozen(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row")))
    total = rows.count()
    blocks = 1 << max(3, min(MOST_BLOCKS.bit_length() - 1, math.ceil(math.log2(max(1, total / block_rows)))))
    mixed = lambda k: F.xxhash64(F.lit(seed + k).cast("long"), "row")
    keyed = rows.withColumn("block", F.pmod(mixed(0), F.lit(blocks).cast("long")))
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    sent = matrix(keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")), sizes, blocks, seed)
    running = "aggregate(caps, cast(array(0L) as array<bigint>), (a, x) -> array_append(a, element_at(a, -1) + x), a -> slice(a, 2, size(caps)))"
    ranked = keyed.withColumn("rank", F.row_number().over(W.partitionBy("block").orderBy(mixed(1), "row")))
    # the first shard whose running sum reaches the rank, by halving
    halve = "if(a.hi > a.lo, if(get(ends, (a.lo + a.hi) div 2) < rank, named_struct('lo', (a.lo + a.hi) div 2 + 1, 'hi', a.hi), named_struct('lo', a.lo, 'hi', (a.lo + a.hi) div 2)), a)"
    home = f"cast(aggregate(sequence(1, {shards.bit_length()}), named_struct('lo', 0L, 'hi', {shards - 1}L), (a, i) -> {halve}, a -> a.lo) as int)".replace("get(ends, (a.lo + a.hi) div 2)", "get(ends, cast((a.lo + a.hi) div 2 as int))")
    dealt = ranked.join(sent.select("block", F.expr(running).alias("ends")), "block").select("doc_id", "size", "text_crc32", "row", F.expr(home).alias("shard"))
    ranges = max(1, math.ceil(total / shards / (4 * block_rows)))
    placed = frozen(dealt.withColumn("part", ((F.shiftrightunsigned(mixed(2), 32) * F.lit(ranges).cast("long")) / F.lit(float(1 << 32))).cast("int")))
    own = W.partitionBy("shard", "part")
    starts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("start"))
    numbered = placed.withColumn("nth", F.row_number().over(own.orderBy(F.shiftrightunsigned(mixed(2), 1), "row")) - 1)
    out = numbered.join(starts, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
