"""The speech front end: pause marks, tokens, facts, phases, chunks. All work inside a row, so nothing shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed as X
from .greedy import groups, let
from .numbers import clamp, rounded
from .segment import _lines, _pieces
from .text import strip

TOKEN = "\u0001[^\u0001]*\u0001|[ក-អ](?:\\.[ក-អ]){1,4}\\.?|[ក-៓]+|[A-Za-z0-9]+(?:[’'&-][A-Za-z0-9]+)*|[.!?,;:…%]+|[^\\s]"


def marks(c: Column) -> Column:
    """(at, sign, plain, level) of each sign that is a pause, in order. Positions count characters from 0."""
    names = F.create_map(*[F.lit(x) for k, v in X.PAUSE_SIGNS.items() for x in (k, v[0])])
    levels = F.create_map(*[F.lit(x) for k, v in X.PAUSE_SIGNS.items() for x in (k, v[1])])
    signs = F.filter(F.transform(F.split(c, ""), lambda x, i: F.struct(i.alias("at"), x.alias("sign"))), lambda s: s["sign"].isin(*X.PAUSE_SIGNS))
    return F.transform(signs, lambda s: F.struct(s["at"].alias("at"), s["sign"].alias("sign"), F.element_at(names, s["sign"]).alias("plain"), F.element_at(levels, s["sign"]).alias("level")))


def tokens(c: Column) -> Column:
    """Protected terms, abbreviations, Khmer runs, Latin words, punctuation, other characters."""
    return F.regexp_extract_all(c, F.lit("(?U)" + TOKEN), F.lit(0))


def join_tokens(a: Column) -> Column:
    """Tokens as text: punctuation joins the token before it, opening signs the one after."""
    first = lambda t: F.substring(t, 1, 1).isin(*X.JOIN_LEFT)
    last = lambda t: F.substring(t, -1, 1).isin(*X.JOIN_RIGHT)
    return F.array_join(F.transform(a, lambda t, i: F.when((i == 0) | first(t) | last(F.get(a, i - 1)), t).otherwise(F.concat(F.lit(" "), t))), "")


def clusters(word: Column) -> Column:
    """A run's orthographic clusters: a base with all that depends on it."""
    return F.regexp_extract_all(word, F.lit("[ក-ឳ][^ក-ឳ]*|^[^ក-ឳ]+"), F.lit(0))


def salience(s: Column) -> Column:
    """(kind, sal): a number with its unit; else a name, not one that only opens the sentence; else an idea."""
    number = F.regexp_extract(s, r"(?U)\b(\d+(?:[.,]\d+)*(?:st|nd|rd|th)?)\s+([A-Za-z]{3,}(?:\s+[A-Za-z]{3,})?)\b", 0)
    spans = F.regexp_extract_all(s, F.lit(r"(?U)\b[A-Z][a-z]{2,}(?:'s)?\b(?:\s+[A-Z][a-z]{2,}(?:'s)?\b){0,2}"), F.lit(0))
    named = F.filter(spans, lambda n: n.rlike(r"\s") | (~F.regexp_replace(n, "['s]+$", "").isin(*X.NOT_NAMES) & ~s.startswith(n)))
    name = F.get(named, 0)
    return F.when(number != "", F.struct(F.lit("number").alias("kind"), number.alias("sal"))).otherwise(F.struct(F.when(name.isNotNull(), "name").otherwise("idea").alias("kind"), name.alias("sal")))


def arc(docs: DataFrame, key: str, text: str, style: str) -> DataFrame:
    """key, index, phase, share, intensity of each sentence. The climax is the longest one, the later of equals; not the last, and not the first of three or more."""
    lo, hi = next((s[1], s[2]) for s in X.STYLES if s[0] == style)
    d = docs.select(key, F.filter(F.split(text, r"(?U)(?<=[.!?។៕៖])\s+"), lambda s: strip(s) != "").alias("_sents"))
    d = d.select(key, F.transform("_sents", F.length).alias("_sizes"), F.size("_sents").alias("_n"))
    d = d.withColumn("_top", F.array_max(F.transform("_sizes", lambda n, i: F.struct(F.when(i < F.col("_n") - 1, n).otherwise(0).alias("n"), i.alias("i"))))["i"])
    d = d.withColumn("_top", F.when((F.col("_top") == 0) & (F.col("_n") > 2), F.col("_n") - 2).otherwise(F.col("_top"))).select(key, "_n", "_top", F.posexplode("_sizes").alias("index", "_size"))
    alone, at, top = F.col("_n") == 1, F.col("index"), F.col("_top")
    d = d.withColumn("share", F.when(alone, 1.0).otherwise(at / F.greatest(F.lit(1), F.col("_n") - 1)))
    phase = F.when(alone, "whole").when(at == top, "climax").when(at > top, "release").when(F.col("share") < 0.25, "opening").when(F.col("share") < 0.65, "build").otherwise("turn")
    part = F.create_map(*[F.lit(x) for kv in X.PHASE_SHARE.items() for x in kv])
    return d.withColumn("phase", phase).select(key, "index", "phase", "share", rounded(clamp(lo + (hi - lo) * F.element_at(part, F.col("phase")), lo, hi)).cast("int").alias("intensity"))


def narrator_chunks(c: Column, limit: int = 2200) -> Column:
    """Sentences packed greedily into chunks of at most `limit` characters; a longer sentence is cut, and only its rest joins others."""

    def cut(p):
        def step(a, _):
            more = F.struct(strip(F.substring(a["rest"], F.lit(limit + 1), F.length(a["rest"]))).alias("rest"), F.array_append(a["out"], strip(F.substring(a["rest"], 1, limit))).alias("out"))
            return F.when(F.length(a["rest"]) > limit, more).otherwise(a)

        start = F.struct(p.alias("rest"), F.array().cast("array<string>").alias("out"))
        done = F.aggregate(F.sequence(F.lit(0), F.floor(F.length(p) / limit).cast("int")), start, step)
        return F.array_append(F.transform(done["out"], lambda x: F.struct(x.alias("t"), F.lit(True).alias("whole"))), F.struct(done["rest"].alias("t"), F.lit(False).alias("whole")))

    def packed(pieces):
        # a cut piece is over the room by itself, so it is alone; each piece brings a blank, the first one's is not there
        sizes = F.transform(pieces, lambda p: F.when(p["whole"], limit + 2).otherwise(F.length(p["t"]) + 1))
        return F.transform(groups(sizes, limit + 1), lambda g: F.array_join(F.transform(F.slice(pieces, g["start"] + 1, g["n"]), lambda p: p["t"]), " "))

    pieces = F.flatten(F.transform(F.flatten(F.transform(_lines(c), lambda x: _pieces(strip(x), ".!?…เ"))), cut))
    return let(F.filter(pieces, lambda p: p["t"] != ""), packed)
