"""Queries of the language front end. Where the tables hold no Khmer, sentences are put together from numbers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantora import oracle as O
from cantora.functions import fixed as X
from cantora.functions import frontend as E
from cantora.functions import text
from cantora.registry import query, table

_LIT = lambda x: "'" + x.replace("'", "''") + "'"


@query(O.CLEANED)
def cleaned_texts(spark, d):
    """Each text's invisible and format signs, counted and removed."""

    @F.arrow_udf(T.StructType([*(T.StructField(c, T.IntegerType()) for c in E.STATS[:5]), T.StructField("text", T.StringType())]))
    def run(batch: E.pa.Array) -> E.pa.Array:
        return E.pa.array([{**n, "text": t} for t, n in map(E.clean, batch.to_pylist())], E.pa.struct([*((c, E.pa.int32()) for c in E.STATS[:5]), ("text", E.pa.string())]))

    rows = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", run("text").alias("c"))
    return rows.select("doc_id", *[F.col(f"c.{c}") for c in E.STATS[:5]], F.md5("c.text").alias("clean_md5"))


@query(O.SAFE)
def safe_texts(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(E.safe(F.col("text"))).alias("safe_md5"))


@query(O.VERBALIZED)
def verbalized(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey % 24 AS h", "cast(l_linenumber * 7 as int) AS mi", "l_orderkey % 28 + 1 AS d", "l_linenumber AS mo", "1900 + l_orderkey % 150 AS y", "l_partkey * 1013 AS p", "cast(l_quantity as long) AS q").distinct()
    line = F.format_string("at %d:%02d on %d/%d/%d for $%d and %d%% of ទី %d by %d នាក់ or %d.%d then %d", "h", "mi", "d", "mo", "y", "p", "q", "q", "q", "q", "d", "p")
    kinds = ["time", "date", "currency", "percent", "ordinal", "unit", "decimal", "number"]
    got = rows.withColumn("e", E.prepared(line, only=["speech", *kinds]))
    return got.select("h", "mi", "d", "mo", "y", "p", "q", F.col("e.speech").alias("said"), *[F.col(f"e.{c}") for c in kinds])


@query(O.SHORT_FORMS)
def short_forms(spark, d):
    forms = [k for k in X.ABBREVIATIONS if not k.endswith(".")]
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % len(forms)).alias("f"), F.col("l_linenumber").alias("n")).distinct()
    form = F.get(F.array(*map(F.lit, forms)), F.col("f").cast("int"))
    line = F.concat(F.lit("a "), form, F.when(F.col("n") % 2 == 0, F.col("n").cast("string")).otherwise(""), F.lit(" អ.ព. "), form, F.lit(". z"))
    return rows.withColumn("e", E.prepared(line)).select("f", "n", F.col("e.speech").alias("said"), F.col("e.abbreviations").alias("known"), F.col("e.unknown").alias("unknown"))


@query("SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'odd' ELSE 'even' END AS grp, CASE WHEN l_orderkey % 3 = 0 THEN ['ក.ខ', 'អ.ព'] ELSE ['អ.ព'] END AS forms FROM lineitem GROUP BY ALL")
def unknown_forms(spark, d):
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 3 == 0, "odd").otherwise("even").alias("grp"), F.when(F.col("l_orderkey") % 3 == 0, "ក.ខ. គ.ស. អ.ព").otherwise("អ.ព. ព.ស").alias("text")).distinct()
    return E.unknown_forms(rows, "grp")


@query(O.REPEATED)
def repeated_words(spark, d):
    rows = spark.createDataFrame([(w,) for w in [*X.REPEATED, "ចកវ"]], "word string").withColumn("e", E.prepared(F.concat("word", F.lit("ៗដោយ x"))))
    return rows.select("word", F.col("e.speech").alias("said"), (F.size("e.unsure") == 0).alias("sure"))


@query(O.PROTECTED)
def protected_terms(spark, d):
    terms = [*X.TITLES, *X.NAMES]
    return spark.createDataFrame([(w,) for w in X.NAMES], "term string").select("term", E._string(lambda t: E.protect(t, terms))(F.format_string("x %s y", "term")).alias("fenced"))


@query(f"SELECT doc_id, far, len([m for m in {[*X.YEAR_MARKERS]} if contains(('a' || k || repeat('-', far))[greatest(0, length(k) + far + 1 - 20) + 1:], m)]) > 0 AS year FROM (SELECT doc_id, (doc_id % 30)::INT AS far, ({[*X.YEAR_MARKERS]})[doc_id % {len(X.YEAR_MARKERS)} + 1] AS k FROM documents)")
def year_marks(spark, d):
    mark = F.get(F.array(*map(F.lit, X.YEAR_MARKERS)), (F.col("doc_id") % len(X.YEAR_MARKERS)).cast("int"))
    far = (F.col("doc_id") % 30).cast("int")
    line = F.concat(F.lit("a"), mark, F.repeat(F.lit("-"), far), F.lit("1999"))
    return table(spark, d, "documents").select("doc_id", far.alias("far"), text.looks_like_year(line, F.length(mark) + far + 1).alias("year"))


@query("SELECT DISTINCT l_extendedprice AS price, trunc(l_extendedprice)::BIGINT AS whole FROM lineitem")
def whole_numbers(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("price")).distinct().select("price", text.whole_number(F.format_number("price", 2)).alias("whole"))


@query()
def prepared_texts(spark, d):
    # by doc_id: a file has few row groups, and the work is in the texts
    rows = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", E.prepared(F.col("text"), only=["speech", "phrased", *E.STATS]).alias("e"))
    return rows.select("doc_id", F.md5("e.speech").alias("speech_md5"), F.md5("e.phrased").alias("phrased_md5"), *[F.col(f"e.{c}") for c in E.STATS])


@query()
def plainly_read_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.md5(E.plainly_read(F.col("text"))).alias("read_md5"))
