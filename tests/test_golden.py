"""Golden texts through Spark on inline rows."""

import pytest
from pyspark.sql import functions as F

from cantora.functions import text as T
from cantora.plans import performance as P
from cantora.sources import files

NUMBERS = {0: "សូន្យ", 8: "ប្រាំបី", 10: "ដប់", 11: "ដប់មួយ", 21: "ម្ភៃមួយ", 70: "ចិតសិប", 100: "មួយរយ", 1000: "មួយពាន់", 1243: "មួយពាន់ពីររយសែសិបបី", 1308: "មួយពាន់បីរយប្រាំបី", 2569: "ពីរពាន់ប្រាំរយហុកសិបប្រាំបួន"}
LINES = {
    "# THE LAST TIME YOU SAID MY NAME": "THE LAST TIME YOU SAID MY NAME", "## Part 7 — Four Hours Away": "Part 7, Four Hours Away", "### 1. The missed call": "The missed call", "- Elias called every morning.": "Elias called every morning.", "**bold** and *italic* and `code`": "bold and italic and code",
    "> a quoted line": "a quoted line", "Elias said — quietly — nothing.": "Elias said, quietly, nothing.", "2020–2023 were hard.": "2020 to 2023 were hard.", "See [the letter](https://x.test) now.": "See the letter now.", "---": "",
}


def one(spark, values, f):
    rows = spark.createDataFrame([(v,) for v in values], ["x"])
    return [r[0] for r in rows.select(f(F.col("x"))).collect()]


def test_numbers(spark):
    assert one(spark, NUMBERS, T.number_words) == list(NUMBERS.values())


def test_ordinals_digits_decimals(spark):
    assert one(spark, [1, 2, 7], T.ordinal_words) == ["ទីមួយ", "ទីពីរ", "ទីប្រាំពីរ"]
    assert one(spark, ["010123123"], T.digit_words) == ["សូន្យ មួយ សូន្យ មួយ ពីរ បី មួយ ពីរ បី"]
    assert one(spark, [5], lambda c: T.decimal_words(F.lit(1), c)) == ["មួយ ចុច ប្រាំ"]
    assert one(spark, ["១៣២៧"], T.khmer_digits) == ["1327"]


def test_manuscript_lines(spark):
    assert one(spark, LINES, T.manuscript) == list(LINES.values())


def test_null_and_empty_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "Hi.")], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in P.units(rows).collect()] == [(3, "Hi.")]
    assert P.plan(rows, only=["news"]).count() == 1


@pytest.mark.parametrize("style", ["meditation", "news", "cinematic"])
def test_plan_stays_in_its_style(spark, style):
    docs = spark.createDataFrame([(1, "The door opened. Blood was on the knife! Was it over? She remembered home.\nThen light, hope and joy came back.")], "doc_id long, text string")
    rows = P.plan(docs, only=[style]).collect()
    spec = {r["style"]: r for r in P.styles(spark).collect()}[style]
    assert len(rows) == 5 and [r.pos for r in sorted(rows, key=lambda r: r.pos)] == list(range(5))
    for r in rows:
        assert spec.lo <= r.intensity <= spec.hi and abs(r.rate - spec.lock_pace) <= 0.0301 and abs(r.gain_db - spec.lock_gain) <= 0.501 and 0 <= r.pause_s <= 4


def test_sources(spark, tmp_path):
    import json
    import wave

    (tmp_path / "lex.json").write_text(json.dumps({"abbreviations": {"a.b.": "alpha"}, "words": {"x": "ex"}, "repetition_bases": ["b"]}))
    known = files.lexicon(spark, str(tmp_path / "lex.json"))
    assert {(r.kind, r.term, r.spoken) for r in known.collect()} == {("abbreviations", "a.b.", "alpha"), ("words", "x", "ex"), ("repetition_bases", "b", None)}
    added = spark.createDataFrame([("words", "x", "eks")], "kind string, term string, spoken string")
    assert {r.spoken for r in files.learn(known, added).filter("kind = 'words'").collect()} == {"eks"}
    (tmp_path / "log.json").write_text('{"cid": "a", "tts": "success", "attempts": 1}\n{broken\n')
    good, bad = files.ledger(spark, str(tmp_path / "log.json"))
    assert good.count() == 1 and bad.count() == 1
    (tmp_path / "pairs.txt").write_text("a|one|two\nnothing\n")
    assert [tuple(r) for r in files.pair_index(spark, str(tmp_path / "pairs.txt")).collect()] == [("a", "one|two")]
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\x00\x40\x00\xc0")
    (tmp_path / "b.wav").write_bytes(b"not a clip")
    got = {r.path.rsplit("/", 1)[1]: (r.sr, r.samples) for r in files.clips(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": (8000, [0.5, -0.5]), "b.wav": (None, None)}


def test_stream_equals_batch(spark, tmp_path):
    from cantora.streaming import jobs

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.limit(300).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = jobs.minutes(rows, "value", late="1 minute").writeStream.outputMode("complete").format("memory").queryName("minutes").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("minutes").collect())) == sorted(map(tuple, jobs.minutes(spark.read.parquet(str(tmp_path / "in")), "value").select(F.col("start").cast("timestamp"), "n", "peak").collect()))


def test_strip_takes_what_the_pattern_takes(spark):
    signs = [chr(k) for k in (*range(33), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    rows = spark.createDataFrame([(t,) for s in signs for t in (s, f"{s}a", f"a{s}", f"{s}a{s} b{s}{s}", f" {s}\n", f"a{s}\n")] + [("",), (None,), ("ក ខ ",)], "t string")
    assert rows.filter(~T.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).collect() == []


def test_windows_of_the_plan_carry_no_style_fields(spark):
    docs = spark.createDataFrame([(1, "One went home. Two died! Why?\nThree"), (2, "")], "doc_id long, text string")
    assert [(r.doc_id, r.pos, r.last) for r in P.units(docs).orderBy("pos").collect()] == [(1, 0, False), (1, 1, False), (1, 2, False), (1, 3, True)]
    nodes = P.plan(docs)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins, windows = ([k for k, x in enumerate(nodes) if word in x] for word in ("Join", "Window ["))
    assert joins[0] < windows[0]  # the fields come in above the windows
