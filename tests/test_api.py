"""The services on small tables."""

from pyspark.sql import functions as F

from cantora import api


def test_services(spark):
    docs = spark.createDataFrame([(1, "$5 went to him. He cried!"), (2, None), (3, "ព្រះបាទ ជ័យវរ្ម័ន ទី ៧។\nបន្ទាប់មក។")], "doc_id long, text string")
    assert {r.doc_id: r.prepared.speech for r in api.prepare(spark, docs).collect()}[1] == "ប្រាំដុល្លារ went to him. He cried!"
    assert api.perform(spark, docs, {"style": "News-Anchor"}).select("emotion").distinct().count() >= 1
    assert {r.style for r in api.plan(spark, docs, {"styles": ["news anchor", "no such"]}).collect()} == {"news", "natural"}
    lines = api.script(spark, docs).collect()
    assert {r.doc_id for r in lines} == {1, 2, 3} and sum(r.doc_id == 3 for r in lines) == 2 + 1 + 2 + 2
    assert api.emotions(spark).count() == 11 and api.styles(spark).count() == 13


def test_learn(spark):
    rules = spark.createDataFrame([("words", "a", "b")], "kind string, term string, spoken string")
    got = api.learn(spark, rules, {"term": " a ", "spoken": "c", "kind": "word"})
    assert [tuple(r) for r in got.collect()] == [("words", "a", "c")] and api.learn(spark, rules, {"term": "x"}).count() == 1


def test_engines_hand_over(spark):
    def broken(text, rate):
        raise OSError("no network")

    def blip(text, rate):
        return b"x"

    def whole(text, rate):
        return b"x" * 10 * len(text)

    units = spark.createDataFrame([(1, "one two three"), (2, ""), (3, None)], "k int, text string")
    got = {r.k: r for r in api.speak(units, "k", {"edge": broken, "mms": blip, "gtts": whole}, len).collect()}
    assert (got[1].ok, got[1].engine, got[1].tried) == (True, "mms", ["edge: OSError"])
    assert not got[2].ok and not got[3].ok and got[2].tried == []
    short = {r.k: r for r in api.speak(units.filter("k = 1").withColumn("text", F.repeat("text", 20)), "k", {"mms": blip, "gtts": whole}, len).collect()}
    assert short[1].engine == "gtts" and short[1].tried == ["mms: truncated audio"]
