"""Packing by doubling pointers against a plain loop, and at a size where copying would not end."""

import random
import time

from pyspark.sql import functions as F

from cantora.functions import greedy
from cantora.functions.segment import chunk_sentences
from cantora.functions.speech import narrator_chunks
from cantora.operators import ledger


def plain(sizes, room, most=None, enough=None):
    out, i = [], 0
    while i < len(sizes):
        j, total = i + 1, sizes[i]
        while j < len(sizes) and (most is None or j - i < most) and total + sizes[j] <= room and (enough is None or total < enough):
            total, j = total + sizes[j], j + 1
        out.append((i, j - i, total))
        i = j
    return out


def test_groups(spark):
    rnd = random.Random(1)
    rows = [(k, [rnd.randint(0, 12) for _ in range(rnd.choice([0, 1, 2, 3, 8, 9, 100, 333]))]) for k in range(60)]
    df = spark.createDataFrame([*rows, (60, None), (61, [None, 3])], "k int, a array<int>")
    for room, most, enough in ((10, None, None), (10, 4, None), (30, 16, 22), (1, None, None), (10**9, None, None), (10, 1, 5)):
        got = {r.k: r.g for r in df.select("k", greedy.groups(F.col("a"), room, most, enough).alias("g")).collect()}
        assert got[60] is None and [g.n for g in got[61]] == ([1, 1] if room == 1 or most == 1 else [2])
        assert all([tuple(g) for g in got[k]] == plain(a, room, most, enough) for k, a in rows), (room, most, enough)


def test_a_million_items_in_one_row(spark):
    began = time.time()
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(999_999)), lambda i: (i.cast("long") * 7919) % 50).alias("a"))
    row = df.select(greedy.groups(F.col("a"), 200, 16).alias("g")).select(F.size("g"), F.aggregate("g", F.lit(0).cast("long"), lambda s, g: s + g["total"]), F.element_at("g", -1)).first()
    want = plain([i * 7919 % 50 for i in range(1_000_000)], 200, 16)
    assert (row[0], row[1], tuple(row[2])) == (len(want), sum(w[2] for w in want), want[-1]) and time.time() - began < 120


def test_chunks_of_text(spark):
    rnd = random.Random(4)
    texts = [[("x" * rnd.choice([3, 40, 90, 279, 280, 281, 700])) for _ in range(rnd.randint(0, 30))] for _ in range(40)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "k int, s array<string>")
    got = {r.k: r.c for r in df.select("k", chunk_sentences(F.col("s")).alias("c")).collect()}
    assert got[99] is None

    def joined(s):
        out, cur = [], []
        for x in s:
            if cur and (len(cur) >= 4 or len(" ".join([*cur, x])) > 280):
                out.append(" ".join(cur))
                cur = []
            cur.append(x)
        return out + ([" ".join(cur)] if cur else [])

    assert all(got[k] == joined(t) for k, t in enumerate(texts))
    cut = spark.createDataFrame([("ab. " * 3 + "y" * 25 + " z. c.",), ("",), (None,)], "t string").select(narrator_chunks(F.col("t"), 10).alias("c")).collect()
    assert [r.c for r in cut] == [["ab. ab.", "ab.", "y" * 10, "y" * 10, "yyyyy z.", "c."], [], []]


def test_batches_of_fractions_add_up_as_a_loop_does(spark):
    def loop(sizes, room, most, trigger):
        out = []
        for x in sizes:
            if not out or out[-1][0] >= most or out[-1][1] >= room * trigger or out[-1][1] + x > room:
                out.append([0, 0.0])
            out[-1] = [out[-1][0] + 1, out[-1][1] + x]
        return [(n, round(total, 4)) for n, total in out]

    rnd = random.Random(11)
    # 0.1 + 0.2 is over 0.3; sums of many sevenths do not fall on millionths
    own = {"a": [0.1, 0.2, 0.1], "b": [k / 7 * 0.01 for k in rnd.choices(range(1, 9), k=200)], "c": [0.4], "d": [0.00001237] * 70}
    rows = spark.createDataFrame([(k, i, x) for k, xs in own.items() for i, x in enumerate(xs)], "k string, pos int, s double")
    got = ledger.batches(rows, "k", ["pos"], "s", 16, 0.3).orderBy("k", "batch").collect()
    for k, xs in own.items():
        assert [(r.n, r.total) for r in got if r.k == k] == loop(xs, 0.3, 16, 0.75), k
