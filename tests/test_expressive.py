"""The expressive plan on a text whose performance is known in part, and its parts against each other."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cantora import catalog
from cantora.functions import fixed as X
from cantora.plans import expressive as E
from cantora.plans import performance

TEXT = (
    "ព្រះបាទជ័យវរ្ម័នទី៧ សោយរាជ្យពីគ.ស. ១១៨១។ បន្តិចម្ដងៗ នគរបានរីកចម្រើន ប៉ុន្តែ ប្រជាជននៅតែរងទុក្ខ ១០០ នាក់ បានទទួល $100។ ប៉ុន្តែ សង្គ្រាមបានមកដល់តំបន់នេះយ៉ាងខ្លាំង។ "
    "ទ្រង់មានបន្ទូលថា “កុំខ្លាច យើងនឹងកសាងឡើងវិញ”។ ចុងក្រោយ ប្រវត្តិសាស្ត្របានចងចាំព្រះអង្គជានិរន្តរ៍។"
)


def planned(spark, rows, style):
    out = {}
    for r in E.units(spark.createDataFrame(rows, "k int, text string"), "k", style).collect():
        out.setdefault(r.k, []).append(r)
    return {k: sorted(v, key=lambda u: u["index"]) for k, v in out.items()}


@pytest.mark.parametrize("style", ["natural", "cinematic", "news", "storytelling"])
def test_plan(spark, style):
    units = planned(spark, [(1, TEXT)], style)[1]
    lo, hi = E.STYLES[style]["lo"], E.STYLES[style]["hi"]
    assert [u.phase for u in units].count("climax") == 1 and units[-1].phase == "release" and [u["index"] for u in units] == list(range(5))
    strength = [u.intensity for u in units]
    assert all(lo <= k <= hi for k in strength) and max(strength) - min(strength) >= 3
    assert sum(k >= lo + 0.75 * (hi - lo) for k in strength) <= max(1, int(5 * 0.34))
    airy = [u.breath >= 0.28 for u in units]
    assert all(u.breath <= 0.31 and u.pitch_st == 0.0 and 0.75 <= u.rate <= 1.30 for u in units) and not any(all(airy[i : i + 3]) for i in range(3))
    assert all(u.delivery in dict(X.DELIVERIES[style]) and abs(u.rate - E.STYLES[style]["lock_pace"]) <= 0.0301 for u in units)
    assert all(a.delivery != b.delivery or a.delivery == X.DELIVERIES[style][3][0] for a, b in zip(units, units[1:], strict=False))
    assert not any(c.isdigit() for u in units for c in u.text) and all(len(u.emphasis) <= 3 for u in units)


def test_a_turn_changes_the_clause(spark):
    units = planned(spark, [(1, TEXT)], "cinematic")[1]
    turned = units[1]
    assert [c["shift"] for c in turned.clauses] == [None, "turn"] and turned.clauses[0].emotion == turned.emotion and turned.clauses[1].emotion == "heartbroken"
    assert any(c.dialogue and c.emotion == "fearful" for u in units for c in u.clauses)
    assert all(" ".join(c.text for c in u.clauses) == u.text for u in units)


def test_shifts(spark):
    rows = spark.createDataFrame([("ហើយ គាត់ទៅ ហើយ គាត់មក ប៉ុន្តែ ស្រាប់តែ គាត់ស្លាប់ ប៉ុន្តែ",), ("none here",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(E.shifts(F.col("t"))).collect()]
    assert [(x.kind, x.word) for x in got[0]] == [("add", "ហើយ"), ("turn", "ប៉ុន្តែ"), ("shock", "ស្រាប់តែ"), ("turn", "ប៉ុន្តែ")] and got[1] == got[2] == [] and not got[3]


def _guarded(spark, units, style):
    shape = "key int, index int, emotion string, intensity int, breath double, pitch_st double, rate double, pitch_span double"
    return sorted(E.guarded(spark.createDataFrame([(1, i, *u) for i, u in enumerate(units)], shape), "key", style).collect(), key=lambda r: r["index"])


def test_guard(spark):
    units = _guarded(spark, [("warm", 30, 0.5, 9.0, 2.0, 9.0)] * 6, "storytelling")
    # 30; each next one differs from the one before by less than 3 and moves by 4; then first and middle are spread
    assert [u.intensity for u in units][1:3] == [34, 30] and units[3].emotion == "thoughtful" and units[-1].emotion == "conclusive"
    assert units[0].pitch_st == 4.0 and units[0].rate == 1.3 and [u.breath for u in units] == [0.3, 0.3, 0.2, 0.2, 0.2, 0.2] and any("variety" in n for n in units[0].guard)
    strong = _guarded(spark, [(e, 70, 0.0, 0.0, 1.0, 1.0) for e in ("warm", "sad", "calm", "proud", "angry", "awed", "epic", "tense")], "storytelling")
    assert sum(u.intensity >= 20 + 0.75 * 55 for u in strong) <= 2


def test_nudges_settle_like_a_walk(spark):
    rnd = random.Random(8)
    rows, want = [], {}
    for k in range(200):
        before = None
        for i in range(rnd.randint(1, 30)):
            emotion, x = rnd.choice("aab"), rnd.randint(20, 28)
            rows.append((k, i, emotion, x))
            if before and before[0] == emotion and abs(before[1] - x) < 3:
                x = max(20, min(28, x + (4 if i % 2 else -4)))
            want[k, i], before = x, (emotion, x)
    got = E.nudged(spark.createDataFrame(rows, "k int, index int, emotion string, intensity int"), "k", 20, 28).collect()
    assert {(r.k, r["index"]): r.intensity for r in got} == want


def test_the_guard_sorts_once_in_tasks_that_do_not_grow(spark, tmp_path):
    # what a task sorts is held in its memory: one sort for all passes, and more tasks for more lines
    shape = "key int, index int, emotion string, intensity int, breath double, pitch_st double, rate double, pitch_span double"
    assert E.guarded(spark.createDataFrame([(1, 0, "warm", 30, 0.5, 9.0, 2.0, 9.0)] * 2, shape), "key", "storytelling")._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    for n, tasks in ((40_000, 2), (100_000, 4), (1_200_000, 5)):
        i = F.col("id")
        lines = spark.range(n).select((i % 100).alias("l_suppkey"), i.alias("l_orderkey"), i.alias("l_partkey"), (i % 7).cast("int").alias("l_linenumber"), (i % 50).cast("double").alias("l_quantity"), (i % 11 / 100).alias("l_discount"), F.lit("A").alias("l_returnflag"))
        lines.write.parquet(f"{tmp_path}/{n}/lineitem.parquet")
        dealt = re.findall(r"Exchange hashpartitioning\(key#\d+L?, (\d+)\)", catalog.QUERIES["guarded_units"](spark, f"{tmp_path}/{n}")._jdf.queryExecution().executedPlan().toString())
        assert dealt == [str(tasks)]


def test_slots_and_guard_share_one_sort(spark):
    plan = E.units(spark.createDataFrame([(1, TEXT)] * 2, "k int, text string"), "k", "cinematic")._jdf.queryExecution().executedPlan().toString()
    # the texts are dealt, then their sentences
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_emotion_cascade(spark):
    cases = [("news", "Go!", None, 0.0, "urgent"), ("natural", "Why?", None, 0.0, "curious"), ("cinematic", "Why?", None, 0.0, "worried"), ("news", "x", "result", 0.0, "conclusive"), ("news", "short", None, 0.95, "conclusive"), ("storytelling", "x", "shock", 0.0, "surprised")]
    rows = spark.createDataFrame(cases, "style string, t string, kind string, place double, want string")
    assert all(r.e == r.want for r in rows.select("want", E.sentence_emotion(F.col("style"), F.col("t"), F.col("kind"), F.col("place")).alias("e")).collect())


def test_empty_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "One."), (4, "x " * 30000)], "k int, text string")
    got = E.units(rows, "k", "news").groupBy("k").count().collect()
    assert {r.k for r in got} == {3, 4} and E.sheet(E.units(rows.filter("k = 3"), "k", "news"), "k").first().sheet.startswith(" 1  [whole] formal")


def test_each_text_is_prepared_once_and_in_several_tasks(spark):
    rows = spark.createDataFrame([(k, TEXT) for k in range(40)], "k int, text string").coalesce(1)
    for plan in (E.units(rows, "k", "cinematic"), performance.units(rows.withColumnRenamed("k", "doc_id"))):
        told = plan._jdf.queryExecution().optimizedPlan().toString()
        assert told.count("RepartitionByExpression") == 1 and told.count("ArrowEvalPython") <= 1
    assert E.units(rows, "k", "cinematic").count() == 200


def test_clauses_of_a_long_sentence_without_signs(spark):
    # a search that starts anew at each character needs over a minute for this
    rows = spark.createDataFrame([("a, “b” " + "word " * 30_000,)], "t string")
    began = time.time()
    none = F.array().cast("array<struct<at:int,kind:string,word:string>>")
    got = rows.select(E.clauses(F.col("t"), F.lit("calm"), none, "natural").alias("c")).first().c
    assert [(c.text[:5], c.dialogue) for c in got] == [("a,", False), ("“b” w", True)] and time.time() - began < 30


def test_stress_phrase_takes_the_first_listed_cue(spark):
    texts = ["He had lost, all hope.", "NEVER CAME BACK! ok", "none", "", "a ស្លាប់បាត់ b", "x, dead " + "y" * 60]
    old = r"(?isu)^(.*?)(" + "|".join(map(re.escape, [w for ws in X.CUES.values() for w in ws])) + ")(.*)$"
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", E.stress_phrase(F.col("t")).alias("s"), F.regexp_extract("t", old, 2).alias("cue"))
    for r in rows.collect():
        assert r.s == "" if r.cue == "" else r.cue in r.s, r
    assert rows.filter("s != ''").count() == 4


def test_stripping_a_clause_is_no_search(spark):
    rows = spark.createDataFrame([(" a b\n",), ("　ក ",), ("",), (None,), ("  \t",)], "t string").select(E.frontend_strip(F.col("t")).alias("s"))
    assert [r.s for r in rows.collect()] == ["a b", "ក", "", "", ""]
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()
