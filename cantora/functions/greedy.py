"""Greedy packing of an ordered array without a step for each item: running sums and pointers that double.

Work grows with n log n: no array is copied for each item, so a row with a million items is as cheap an item as a short one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_POWERS = [1 << k for k in range(31)]


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def powers(below: Column) -> Column:
    """1, 2, 4, ... under a number."""
    return F.filter(F.array(*map(F.lit, _POWERS)), lambda p: p < below)


def running(a: Column, steps: Column) -> Column:
    """Sums of the first 1, 2, 3, ... of an array of whole numbers: each round adds what lies twice as far back. steps: powers of its size; both bound by let."""
    return F.aggregate(steps, a, lambda s, p: F.transform(s, lambda x, i: F.when(i < p, x).otherwise(x + F.get(s, i - p))))


def last_within(sums: Column, i: Column, bound: Column, falling: Column) -> Column:
    """The last place from i on whose sum is within bound; i - 1 if there is none. sums do not fall; falling: powers, largest first."""
    return F.aggregate(falling, i - 1, lambda at, p: F.when(F.get(sums, at + p) <= bound, at + p).otherwise(at))


def orbit(following: Column, steps: Column, n: Column) -> Column:
    """0, following[0], following[following[0]], ... while under n: each round doubles the pointers' reach and the places found. following[i] > i; steps: as many rounds."""
    first = F.struct(following.alias("jump"), F.array(F.lit(0)).alias("found"))

    def double(s, _):
        more = F.filter(F.transform(s["found"], lambda i: F.get(s["jump"], i)), lambda i: i < n)
        return F.struct(F.transform(s["jump"], lambda j: F.coalesce(F.get(s["jump"], j), n)).alias("jump"), F.concat(s["found"], more).alias("found"))

    return F.aggregate(steps, first, double, lambda s: s["found"])


def groups(sizes: Column, room: Column | int, most: int | None = None, enough: Column | int | None = None) -> Column:
    """(start, n, total) of each group when items are packed in order: a group takes items while their sizes (whole numbers, 0 or more; null is 0) add up to `room` at most, and at most `most`; one over the room is alone. With `enough` a group also ends as soon as it has that much. Null for a null array."""
    zero = F.lit(0).cast("long")

    def with_steps(b):
        n, steps = b["n"], b["steps"]

        def with_sums(c):
            sums, falling = c["sums"], c["falling"]

            def after(i, before):
                ends = [last_within(sums, i, before + room, falling) + 1]
                ends += [i + most] if most else []
                # one more than what stays short of enough
                ends += [last_within(sums, i, before + (enough - 1), falling) + 2] if enough is not None else []
                return F.greatest(i + 1, F.least(n, *ends))

            following = F.transform(b["sizes"], lambda x, i: after(i, F.get(sums, i) - x))

            def told(starts):
                def group(i, k):
                    end = F.coalesce(F.get(starts, k + 1), n)
                    return F.struct(i.alias("start"), (end - i).alias("n"), (F.get(sums, end - 1) - F.coalesce(F.get(sums, i - 1), zero)).alias("total"))

                return F.transform(starts, group)

            return let(let(following, lambda f: orbit(f, steps, n)), told)

        # a search over `most` items needs no longer steps
        falling = F.reverse(F.filter(steps, lambda p: p <= most) if most else steps)
        return let(F.struct(running(b["sizes"], steps).alias("sums"), falling.alias("falling")), with_sums)

    whole = F.transform(sizes, lambda x: F.coalesce(x.cast("long"), zero))
    none = F.array().cast("array<struct<start:int,n:int,total:bigint>>")
    packed = let(F.struct(whole.alias("sizes"), F.size(sizes).alias("n"), powers(F.size(sizes) + 1).alias("steps")), with_steps)
    return F.when(F.size(sizes) > 0, packed).when(sizes.isNotNull(), none)


def added_groups(sizes: Column, room: float, most: int, enough: float) -> Column:
    """(start, n, total) by the rule of groups, for sizes that are no whole numbers (null is 0): a group's total is added up item after item from its first one, so it rounds, and ends, as a loop over the items would. Each place looks at the `most` items from it on, and no further."""
    zero = F.lit(0.0)

    def filled(own, x, i):
        first = F.struct(F.lit(1).alias("n"), x.alias("total"), F.lit(False).alias("full"))

        def step(a, y):
            full = a["full"] | (a["total"] >= enough) | (a["total"] + y > room)
            return F.struct((a["n"] + F.when(full, 0).otherwise(1)).alias("n"), F.when(full, a["total"]).otherwise(a["total"] + y).alias("total"), full.alias("full"))

        return F.aggregate(F.slice(own, i + 2, F.lit(most - 1)), first, step)

    def told(b):
        starts = lambda f: orbit(F.transform(f, lambda g, i: i + g["n"]), b["steps"], F.size(f))
        group = lambda f: lambda i: F.struct(i.alias("start"), F.get(f, i)["n"].alias("n"), F.get(f, i)["total"].alias("total"))
        return let(F.transform(b["sizes"], lambda x, i: filled(b["sizes"], x, i)), lambda f: F.transform(starts(f), group(f)))

    whole = F.transform(sizes, lambda x: F.coalesce(x.cast("double"), zero))
    none = F.array().cast("array<struct<start:int,n:int,total:double>>")
    return F.when(F.size(sizes) > 0, let(F.struct(whole.alias("sizes"), powers(F.size(sizes) + 1).alias("steps")), told)).when(sizes.isNotNull(), none)
