"""Queries of the expressive layer."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cantora import oracle as O
from cantora.functions import fixed as X
from cantora.plans import expressive as E
from cantora.plans import performance as P
from cantora.registry import query, table


@query(O.FAMILIES)
def emotion_families(spark, d):
    return E.families(spark)


@query(O.EMPHASES)
def emphasised_words(spark, d):
    n = len(X.STRESS_WORDS)
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % n).alias("i"), F.col("l_linenumber").alias("n")).distinct()
    word = lambda at: F.get(F.array(*map(F.lit, X.STRESS_WORDS)), at.cast("int"))
    more = F.when(F.col("n") % 2 == 0, F.concat(word((F.col("i") + 7) % n), F.lit("xyz"))).otherwise("")
    line = F.concat_ws(" ", F.concat(word(F.col("i")), F.lit("!")), F.lit("និង"), more, F.lit(X.TITLES[0]), F.lit(f'"{X.NAMES[0]}"'), F.lit("abc"), word((F.col("i") + 3) % n))
    return rows.select("i", "n", E.emphases(line).alias("words"))


@query(O.SENTENCE_EMOTIONS)
def sentence_emotions(spark, d):
    rows = P.units(table(spark, d, "documents")).withColumn("n", F.max("pos").over(W.partitionBy("doc_id")) + 1).withColumn("style", F.explode(F.array(F.lit("news"), F.lit("cinematic"), F.lit("natural"))))
    kind = F.when(F.col("pos") % 5 == 1, "turn").when(F.col("pos") % 7 == 2, "result")
    return rows.select("doc_id", "pos", "style", E.sentence_emotion(F.col("style"), F.col("text"), kind, F.col("pos") / F.greatest(F.lit(1), F.col("n") - 1)).alias("emotion"))


@query(O.STRESSED)
def stress_phrases(spark, d):
    return P.units(table(spark, d, "documents")).select("doc_id", "pos", E.stress_phrase(F.col("text")).alias("stress"))


@query()
def performed_units(spark, d):
    rows = E.units(table(spark, d, "documents"), "doc_id", "cinematic")
    return rows.select("doc_id", "index", "phase", "emotion", "intensity", "rate", "energy_db", "before", "after", "breath", "delivery", F.size("clauses").alias("clauses"))


@query()
def performance_summaries(spark, d):
    return E.summary(E.units(table(spark, d, "documents"), "doc_id", "documentary"), "doc_id")


@query()
def performance_sheets(spark, d):
    return E.sheet(E.units(table(spark, d, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn")), "key", "storytelling"), "key")


@query(O.GUARDED_UNITS)
def guarded_units(spark, d):
    lo, hi = E.STYLES["storytelling"]["lo"], E.STYLES["storytelling"]["hi"]
    strength = lo + F.when(F.col("l_suppkey") % 5 == 0, 20).otherwise(F.col("l_quantity") * (hi - lo) / 60)
    order = ["l_orderkey", "l_linenumber", "l_partkey"]
    lines = table(spark, d, "lineitem")
    rows = lines.select(F.col("l_suppkey").alias("key"), *order, F.when(F.col("l_suppkey") % 7 == 0, "A").otherwise(F.col("l_returnflag")).alias("emotion"), F.rint(strength).cast("int").alias("intensity"), (F.col("l_discount") * 4.5).alias("breath"))
    # one deal serves the numbering and the guard; a task has some 262,144 lines at any size of the table
    rows = E.dealt(rows, "key", lines.count(), 1 << 14, 1 << 18)
    at = F.row_number().over(W.partitionBy("key").orderBy(*order)) - 1
    rows = rows.select("key", at.alias("index"), "emotion", "intensity", "breath", F.lit(0.0).alias("pitch_st"), F.lit(1.0).alias("rate"), F.lit(1.0).alias("pitch_span"))
    return E.guarded(rows, "key", "storytelling").select("key", "index", "emotion", "intensity", "breath")


@query(O.SENTENCE_CLAUSES)
def sentence_clauses(spark, d):
    said = F.when(F.col("pos") % 3 == 0, F.regexp_replace("text", ", ([^ ,]+) ", ", “$1” ")).otherwise(F.col("text"))
    rows = P.units(table(spark, d, "documents")).select("doc_id", "pos", said.alias("text"), F.lit("calm").alias("emotion"))
    rows = rows.withColumn("shifts", E.shifts(F.col("text")))
    return rows.select("doc_id", "pos", F.posexplode(E.clauses(F.col("text"), F.col("emotion"), F.col("shifts"), "natural")).alias("no", "c")).select("doc_id", "pos", "no", F.col("c.text").alias("clause"), "c.emotion", "c.dialogue")
