"""Queries of word segmentation. Short words of the documents are the dictionary; their longer words, written without spaces as they are, are the runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantora.functions import words as S
from cantora.registry import query, table

#: Letters that runs consist of.
_LETTERS = "a-zà-öø-ÿß"
_DICTIONARY_SQL = f"""
    t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[{_LETTERS}]+')) AS w FROM documents),
    d AS (SELECT w AS word, 100 - length(w) * 10 + count(DISTINCT doc_id) % 7 AS cost, length(w) = 2 AS number FROM t WHERE length(w) BETWEEN 2 AND 5 GROUP BY w HAVING count(DISTINCT doc_id) >= 20)"""


def _words(spark, d):
    # by doc_id: a file has few row groups
    docs = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[{_LETTERS}]+"), F.lit(0))).alias("w"))
    return docs.groupBy("w").agg(F.count_distinct("doc_id").alias("n"))


def _dictionary(words):
    return words.filter("length(w) BETWEEN 2 AND 5 AND n >= 20").select(F.col("w").alias("word"), (100 - F.length("w") * 10 + F.col("n") % 7).alias("cost"), (F.length("w") == 2).alias("number"))


@query(f"""
    WITH RECURSIVE {_DICTIONARY_SQL},
    m AS MATERIALIZED (SELECT map(list(word), list(cost)) AS costs, list(word) FILTER (number) AS numbers FROM d),
    r AS (SELECT DISTINCT w AS run FROM t),
    f AS (
        SELECT run, 0 AS i, [0::BIGINT] AS cost, []::STRUCT("from" INT, known BOOLEAN)[] AS back FROM r
        UNION ALL
        SELECT run, i + 1, list_append(cost, b.c), list_append(back, {{'from': b.f, 'known': b.k}})
        FROM (
            SELECT run, i, cost, back, list_sort([
                {{'c': cost[i + 2 - n] + coalesce(costs[substr(run, i + 2 - n, n)], 1000), 'f': (i + 1 - n)::INT, 'k': costs[substr(run, i + 2 - n, n)] IS NOT NULL}}
                FOR n IN range(1, 6) IF n <= i + 1 AND (n = 1 OR costs[substr(run, i + 2 - n, n)] IS NOT NULL)
            ])[1] AS b FROM f, m WHERE i < length(run)
        )
    ),
    p AS (
        SELECT run, length(run)::INT AS z, back, []::STRUCT(w VARCHAR, k BOOLEAN)[] AS out FROM f WHERE i = length(run)
        UNION ALL
        SELECT run, back[z]['from'], back, list_prepend({{'w': substr(run, back[z]['from'] + 1, z - back[z]['from']), 'k': back[z].known}}, out) FROM p WHERE z > 0
    ),
    g AS (
        SELECT run, x.w AS w, i, sum((x.k OR coalesce(lag_k, true))::INT) OVER (PARTITION BY run ORDER BY i) AS grp
        FROM (SELECT run, i, out[i] AS x, out[i - 1].k AS lag_k FROM (SELECT run, out FROM p WHERE z = 0), range(1, len(out) + 1) AS u(i))
    ),
    w AS (SELECT run, list(w ORDER BY grp) AS words FROM (SELECT run, grp, string_agg(w, '' ORDER BY i) AS w FROM g GROUP BY ALL) GROUP BY run)
    SELECT run, CASE WHEN len(list_filter(words, lambda x: NOT list_contains(numbers, x))) = 0 THEN [run] ELSE words END AS words FROM w, m
""")
def segmented_words(spark, d):
    # the dictionary, its sizes and the runs are all made of the words, which are found once
    words = _words(spark, d).cache()
    return S.segment_runs(words.select(F.col("w").alias("run")), _dictionary(words))
