"""Two hosts talk about a text: its facts read in turn, each announced by the other host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantora.functions import fixed as X
from cantora.functions.segment import dialogue_sentences
from cantora.functions.speech import salience
from cantora.functions.text import strip, topic


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0))


def title(c: Column) -> Column:
    """First line without quotes and dashes around it, cut at 70 characters to a word, without closing signs."""
    line = F.regexp_replace(strip(F.substring_index(strip(F.coalesce(c, F.lit(""))), "\n", 1)), "^[ \t\"'“”—–:-]+|[ \t\"'“”—–:-]+$", "")
    head = F.substring(line, 1, 70)
    cut = F.when(head.contains(" "), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", "this topic").otherwise(F.regexp_replace(F.when(F.length(line) > 70, cut).otherwise(line), r"[ .,:;—…-]+$", ""))


def _line(host: str, said: Column) -> Column:
    return F.struct(F.lit(host).alias("s"), said.alias("text"))


def _fill(pattern: str, *values: Column) -> Column:
    parts = pattern.split("{}")
    return F.concat(F.lit(parts[0]), *[x for v, p in zip(values, parts[1:], strict=True) for x in (v, F.lit(p))])


def hosts(docs: DataFrame, key: str, text: str = "text", most: int = 8) -> DataFrame:
    """key, pos, s, text: the whole conversation. Facts are sentences of six words or more (all sentences, if none), `most` evenly spaced ones at most."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(key, t.alias("_t"), dialogue_sentences(t).alias("sents"), title(t).alias("topic"))
    d = d.withColumn("long", F.filter("sents", lambda s: F.size(_words(s)) >= 6))
    d = d.select(key, "topic", F.when(F.size("long") > 0, F.col("long")).when(F.size("sents") > 0, F.col("sents")).otherwise(F.array(strip(F.col("_t")))).alias("f"))
    n = F.size("f")
    spaced = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(F.col("f"), F.rint(i * (n - 1) / (most - 1.0)).cast("int")))
    d = d.withColumn("f", F.when(n > most, spaced).otherwise(F.col("f")))
    d = d.withColumn("sal", F.transform("f", salience))

    def react(i):
        own = F.get("sal", i)
        before = F.size(F.filter(F.slice("sal", F.lit(2), F.greatest(F.lit(0), i - 1)), lambda x: x["kind"] == own["kind"]))
        pick = lambda kind: F.get(F.array(*map(F.lit, X.HOST_TEASERS[kind])), before % len(X.HOST_TEASERS[kind]))
        return F.when(own["kind"] == "number", pick("number")).when(own["kind"] == "name", F.replace(pick("name"), F.lit("{sal}"), own["sal"])).otherwise(pick("idea"))

    def told(f, i):
        even = i % 2 == 0
        said = F.struct(F.when(even, "A").otherwise("B").alias("s"), F.when(i == 0, F.concat(F.lit(X.HOST_INTRO["first"]), f)).otherwise(f).alias("text"))
        announced = F.struct(F.when(even, "B").otherwise("A").alias("s"), react(i).alias("text"))
        return F.when(i == 0, F.array(said)).otherwise(F.array(announced, said))

    topic = F.col("topic")
    words, first, last = _words(topic), F.get("sal", 0)["sal"], F.get("sal", F.size("sal") - 1)["sal"]
    short = F.when(F.size(words) > 7, F.regexp_replace(F.array_join(F.slice(words, 1, 7), " "), "[,;: ]+$", "")).otherwise(topic)
    opening = F.when(F.size(words) > 6, _fill(X.HOST_INTRO["sentence"], F.array_join(F.slice(words, 1, 5), " "))).otherwise(_fill(X.HOST_INTRO["title"], topic))
    none = F.lit(False)
    closing = F.when(F.coalesce(~short.contains(last), none), _fill(X.HOST_OUTRO["detail"], last)).when(F.coalesce((first != last) & ~short.contains(first), none), _fill(X.HOST_OUTRO["span"], short, first, last)).otherwise(_fill(X.HOST_OUTRO["plain"], short))
    bye = X.HOST_OUTRO["last"]
    lines = F.concat(F.array(_line("A", opening), _line("B", F.lit(X.HOST_INTRO["reply"]))), F.flatten(F.transform("f", told)), F.array(_line("A", closing), *[_line(h, F.lit(x)) for h, x in zip("BAB", bye, strict=True)]))
    return d.select(key, F.posexplode(lines).alias("pos", "line")).select(key, "pos", "line.s", "line.text")


def paragraph_hosts(docs: DataFrame, key: str, lang: str, text: str = "text") -> DataFrame:
    """key, pos, s, text: two hosts read a Thai or Khmer text's paragraphs in turn; before each but the first, the host who reads it next takes over with a phrase of its own cycle."""
    say, t = X.PARAGRAPH_HOSTS[lang], strip(F.coalesce(F.col(text), F.lit("")))
    paras = F.filter(F.transform(F.split(t, r"(?U)\n\s*\n|\n"), strip), lambda p: p != "")
    d = docs.select(key, F.when(F.size(paras) > 0, paras).otherwise(F.array(t)).alias("p"), topic(F.coalesce(F.col(text), F.lit(""))).alias("topic"))

    def told(p, i):
        even = i % 2 == 0
        turn = F.floor((i - 1) / 2).cast("int")  # how often this host took over before
        bridge = F.when(even, F.get(F.array(*map(F.lit, say["B"])), turn % len(say["B"]))).otherwise(F.get(F.array(*map(F.lit, say["A"])), turn % len(say["A"])))
        own = F.struct(F.when(even, "A").otherwise("B").alias("s"), p.alias("text"))
        return F.when(i == 0, F.array(own)).otherwise(F.array(F.struct(F.when(even, "B").otherwise("A").alias("s"), bridge.alias("text")), own))

    lines = F.concat(F.array(_line("A", _fill(say["open"][0], F.col("topic"))), _line("B", F.lit(say["open"][1]))), F.flatten(F.transform("p", told)), F.array(_line("A", F.lit(say["close"][0])), _line("B", F.lit(say["close"][1]))))
    return d.select(key, F.posexplode(lines).alias("pos", "line")).select(key, "pos", "line.s", "line.text")
