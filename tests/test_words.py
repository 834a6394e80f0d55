"""Words of unspaced runs against a plain least-cost search."""

import random

import pytest

from cantora.functions import words as S
from cantora.functions.segment import studio_units
from pyspark.sql import functions as F

SHAPE = "word string, cost int, number boolean"


def plain(run, cost):
    best = [(0, None)]
    for i in range(1, len(run) + 1):
        ways = [(best[j][0] + cost[run[j:i]], j) for j in range(i) if run[j:i] in cost]
        best.append(min([*ways, (best[i - 1][0] + S.UNKNOWN, i - 1)]))
    out, i = [], len(run)
    while i:
        j = best[i][1]
        out.append((run[j:i], best[i][0] - best[j][0] < S.UNKNOWN))
        i = j
    out, joined = out[::-1], []
    for w, known in out:
        if joined and not known and not joined[-1][1]:
            joined[-1] = (joined[-1][0] + w, False)
        else:
            joined.append((w, known))
    return [w for w, _ in joined]


@pytest.mark.parametrize("small", [S.SMALL, 0])
def test_least_cost(spark, monkeypatch, small):
    monkeypatch.setattr(S, "SMALL", small)
    rnd = random.Random(3)
    cost = {"".join(rnd.choices("abc", k=rnd.randint(1, 5))): rnd.randint(1, 90) for _ in range(25)}
    cost = {w: c for w, c in cost.items() if w != "c"}
    runs = sorted({"".join(rnd.choices("abcd", k=rnd.randint(1, 40))) for _ in range(150)}) + ["ab" * 400, "d" * 3000]
    d = spark.createDataFrame([(w, c, False) for w, c in cost.items()] + [(w, c + 5, False) for w, c in cost.items()] + [("", 1, False)], SHAPE)
    got = {r.run: r.words for r in S.segment_runs(spark.createDataFrame([(r,) for r in runs * 2] + [(None,), ("",)], "run string"), d).collect()}
    assert got == {r: plain(r, cost) for r in runs}


def test_khmer(spark):
    d = spark.createDataFrame([("ខ្ញុំ", 5, False), ("ស្រលាញ់", 5, False), ("អ្នក", 5, False), ("ពាន់", 5, True), ("មួយ", 5, True), ("ទី", 5, None), ("ប្រាំ", 5, True)], SHAPE)
    runs = ["ខ្ញុំស្រលាញ់អ្នក", "មួយពាន់", "ទីប្រាំ", "ទី", "មួយអ្នក", "ឃឃឃ"]
    got = {r.run: r.words for r in S.segment_runs(spark.createDataFrame([(r,) for r in runs], "run string"), d).collect()}
    assert got == {runs[0]: ["ខ្ញុំ", "ស្រលាញ់", "អ្នក"], "មួយពាន់": ["មួយពាន់"], "ទីប្រាំ": ["ទីប្រាំ"], "ទី": ["ទី"], "មួយអ្នក": ["មួយ", "អ្នក"], "ឃឃឃ": ["ឃឃឃ"]}
    assert [r.words for r in S.segment_runs(spark.createDataFrame([("ខ្ញុំ",)], "run string"), d.limit(0)).collect()] == [["ខ្ញុំ"]]
    docs = spark.createDataFrame([(1, "ខ្ញុំស្រលាញ់អ្នក។ a ទីប្រាំ! ឃ"), (2, "plain"), (3, None)], "doc_id int, text string")
    text = {r.doc_id: r.text for r in S.spaced(docs, "doc_id", "text", d).collect()}
    assert text == {1: "ខ្ញុំ ស្រលាញ់ អ្នក។ a ទីប្រាំ! ឃ", 2: "plain", 3: None}
    units = S.spaced(docs, "doc_id", "text", d).filter("doc_id = 1").select(studio_units(F.col("text")).alias("u")).first().u
    assert [u.text for u in units] == ["ខ្ញុំ ស្រលាញ់ អ្នក។", "a ទីប្រាំ!", "ឃ"]


def test_queries_of_texts_deal_them_first(spark, tmp_path):
    from cantora import catalog

    rows = [(k, "One two. Three, four! five" * 3, "en", "web", 78) for k in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("studio_units", "text_profile", "sentence_units", "feelings", "prepared_texts", "plainly_read_texts"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [doc_id" in plan, name
