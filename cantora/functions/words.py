"""Words of runs that are written without spaces: a least-cost path over a dictionary, for each distinct run once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cost of a character that no dictionary word covers; a dictionary's costs are whole numbers below it.
UNKNOWN = 1000
#: Bytes up to which the dictionary is sent to all tasks; a larger one is joined by word.
SMALL = 32 << 20
#: Letters of a Khmer run.
KHMER = "ក-៓"


def _sized(table: DataFrame, column: str) -> DataFrame:
    """table, marked for sending to all tasks if its measured size allows that."""
    size = table.agg(F.sum(F.octet_length(column) + 32)).first()[0] or 0
    return F.broadcast(table) if size <= SMALL else table


def prefixes(dictionary: DataFrame) -> DataFrame:
    """(head, longest): of each pair of first letters (one, for a word of one), the length of its longest word."""
    return dictionary.groupBy(F.substring("word", 1, 2).alias("head")).agg(F.max(F.length("word")).alias("longest"))


def _starts(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.struct(i.alias("at"), F.substring(run, i, F.lit(2)).alias("two"), F.substring(run, i, F.lit(1)).alias("one")))


def _path(size: Column, steps: Column) -> Column:
    """Tokens (from, to, known) of the cheapest path, ties to the longer last word. steps[i]: the words that end at i + 1, as (from, cost)."""
    first = F.struct(F.array(F.lit(0).cast("long")).alias("cost"), F.array().cast("array<struct<from:int,known:boolean>>").alias("back"))

    def forth(a, i):
        ways = F.transform(F.get(steps, i), lambda s: F.struct((F.get(a["cost"], s["from"]) + s["cost"]).alias("cost"), s["from"].alias("from"), (s["cost"] < UNKNOWN).alias("known")))
        best = F.array_min(ways)
        return F.struct(F.array_append(a["cost"], best["cost"]).alias("cost"), F.array_append(a["back"], F.struct(best["from"].alias("from"), best["known"].alias("known"))).alias("back"))

    back = F.aggregate(F.sequence(F.lit(0), size - 1), first, forth, lambda a: a["back"])
    end = F.struct(size.alias("to"), F.array().cast("array<struct<from:int,to:int,known:boolean>>").alias("out"))

    def home(back):
        def step(a, i):
            at = F.get(back, i - 1)
            own = F.struct(at["from"].alias("from"), i.alias("to"), at["known"].alias("known"))
            return F.when(a["to"] == i, F.struct(at["from"].alias("to"), F.array_append(a["out"], own).alias("out"))).otherwise(a)

        return F.reverse(F.aggregate(F.sequence(size, F.lit(1), F.lit(-1)), end, step, lambda a: a["out"]))

    return F.transform(F.array(back), home)[0]


def segment_runs(runs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(run, words): each distinct run's cheapest cut into dictionary words (word, cost, number), by the sum of their costs.

    Characters that no word covers cost UNKNOWN each and stay together as one word. Ties go to the longer last word. A run
    of number words alone, after a first one whose `number` is null (an ordinal sign), stays whole, as does a run that the
    dictionary has nothing for. A run is first cut where no word lies across, so that the path is searched in short
    stretches; the search is quadratic in such a stretch alone.

    Null and empty runs give nothing; words that the dictionary has twice count with their least cost; an empty
    dictionary leaves each run whole.
    """
    known = dictionary.filter("word != ''").groupBy("word").agg(F.min("cost").cast("int").alias("cost"), F.max_by("number", F.col("number").isNotNull().cast("int")).alias("number"))
    heads = _sized(prefixes(known), "head")
    base = runs.select("run").filter("run != ''").distinct()
    at = base.select("run", F.explode(_starts(F.col("run"))).alias("s")).select("run", F.col("s.at").alias("at"), F.col("s.two").alias("two"), F.col("s.one").alias("one"))
    two = heads.select(F.col("head").alias("two"), F.col("longest").alias("l2"))
    one = heads.select(F.col("head").alias("one"), F.col("longest").alias("l1"))
    spans = at.join(two, "two", "left").join(one, "one", "left").withColumn("most", F.least(F.greatest(F.coalesce("l2", F.lit(0)), F.coalesce("l1", F.lit(0))), F.length("run") - F.col("at") + 1)).filter("most > 0")
    spans = spans.select("run", "at", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("n")).withColumn("word", F.expr("substring(run, at, n)"))
    hits = spans.join(_sized(known, "word"), "word").select("run", (F.col("at") - 1).alias("from"), (F.col("at") + F.col("n") - 1).alias("to"), "cost", "number")

    words = hits.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("from", "to", "cost", "number"))).alias("hits"))
    # places that a word lies across are no edges of a stretch
    full = base.join(words, "run", "left").withColumn("hits", F.coalesce("hits", F.array().cast(words.schema["hits"].dataType)))
    reach = F.aggregate("hits", F.struct(F.lit(0).alias("far"), F.array(F.lit(0)).alias("cuts")), lambda a, h: F.struct(F.greatest(a["far"], h["to"]).alias("far"), F.when(h["from"] >= a["far"], F.array_append(a["cuts"], h["from"])).otherwise(a["cuts"]).alias("cuts")), lambda a: F.array_distinct(F.array_append(a["cuts"], a["far"])))
    full = full.withColumn("cuts", F.array_distinct(F.concat(reach, F.array(F.length("run")))))
    part = full.select("run", "hits", F.posexplode(F.arrays_zip(F.slice("cuts", F.lit(1), F.greatest(F.lit(0), F.size("cuts") - 1)).alias("a"), F.slice("cuts", F.lit(2), F.size("cuts")).alias("b"))).alias("part", "p"))
    lo, hi = F.col("p")["a"], F.col("p")["b"]
    part = part.select("run", "part", lo.alias("lo"), (hi - lo).alias("size"), F.filter("hits", lambda h: (h["from"] >= lo) & (h["to"] <= hi)).alias("own"))
    ends = F.transform(
        F.sequence(F.lit(1), F.col("size")),
        lambda i: F.array_append(F.transform(F.filter("own", lambda h: h["to"] == F.col("lo") + i), lambda h: F.struct((h["from"] - F.col("lo")).alias("from"), h["cost"].alias("cost"))), F.struct((i - 1).alias("from"), F.lit(UNKNOWN).alias("cost"))),
    )
    done = part.withColumn("path", _path(F.col("size"), ends)).select("run", "part", F.transform("path", lambda t: F.struct((t["from"] + F.col("lo")).alias("from"), (t["to"] + F.col("lo")).alias("to"), t["known"].alias("known"))).alias("path"))
    whole = done.groupBy("run").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "path"))), lambda p: p["path"])).alias("path"))
    # an end between two unknown tokens is none
    ends = F.filter("path", lambda t, i: t["known"] | F.coalesce(F.get("path", i + 1)["known"], F.lit(True)))
    cut = whole.withColumn("ends", F.transform(ends, lambda t: t["to"])).select("run", F.transform("ends", lambda e, i: F.substring(F.col("run"), _before(i) + 1, e - _before(i))).alias("words"))
    told = full.select("run", F.transform("hits", lambda h: F.struct(F.substring(F.col("run"), h["from"] + 1, h["to"] - h["from"]).alias("w"), h["number"].alias("n"))).alias("told"))
    numbers = F.transform(F.filter("told", lambda t: t["n"]), lambda t: t["w"])
    signs = F.transform(F.filter("told", lambda t: t["n"].isNull()), lambda t: t["w"])
    core = F.when(F.array_contains(signs, F.get("words", 0)), F.slice("words", F.lit(2), F.size("words"))).otherwise(F.col("words"))
    alone = (F.size(core) > 0) & F.forall(core, lambda w: F.array_contains(numbers, w))
    return cut.join(told, "run").select("run", F.when(alone, F.array("run")).otherwise(F.col("words")).alias("words"))


def _before(i: Column) -> Column:
    return F.coalesce(F.when(i > 0, F.get("ends", i - 1)), F.lit(0))


def spaced(docs: DataFrame, key: str, text: str, dictionary: DataFrame, letters: str = KHMER) -> DataFrame:
    """(key, text): texts whose runs of `letters` have spaces between their words. Keys are distinct; a text without runs, and a null one, stays."""
    has = F.coalesce(F.col(text).rlike(f"[{letters}]"), F.lit(False))
    pieces = docs.filter(has).select(key, F.posexplode(F.regexp_extract_all(text, F.lit(f"[{letters}]+|[^{letters}]+"), F.lit(0))).alias("at", "run"))
    words = segment_runs(pieces.filter(F.col("run").rlike(f"^[{letters}]")), dictionary)
    whole = pieces.join(words, "run", "left").withColumn("out", F.coalesce(F.array_join("words", " "), "run"))
    whole = whole.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]), "").alias(text))
    return docs.filter(~has).select(key, text).unionByName(whole)
