"""The corpus operators' queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_corpus

    return score_corpus(_table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compress

    return compress(_table(spark, sf_dir, "embeddings"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binpack import best_fit_pack

    return best_fit_pack(_table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_packing, op3_near_duplicates, op4_exact_dedup, op5_lm_scoring, op6_nearest, op7_language_id, op8_suffix_dedup, op9_mixing, op10_sharding, op11_divergence, op12_vector_codes, op13_best_fit)}



def _codes_sql(rounds: int = 2) -> str:
    """Every part against every entry, round by round."""
    assign = """
        a{k} AS MATERIALIZED (
            SELECT y.id, y.p, arg_min(c.i, d * 64 + c.i) AS i, min(d) AS d
            FROM y JOIN c{k} AS c ON c.p = y.p, LATERAL (SELECT list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(y.v, c.v)])::BIGINT AS d) GROUP BY ALL
        )"""
    move = """
        s{k} AS (SELECT y.p, a.i, j, sum(y.v[j]) AS s, count(*) AS n FROM y JOIN a{k} AS a ON a.id = y.id AND a.p = y.p, unnest(range(1, len(y.v) + 1)) AS u(j) GROUP BY ALL),
        m{k} AS (SELECT p, i, list((s - ((s % n) + n) % n) // n ORDER BY j)::BIGINT[] AS v FROM s{k} GROUP BY ALL),
        c{n} AS MATERIALIZED (SELECT c.p, c.i, coalesce(m.v, c.v) AS v FROM c{k} AS c LEFT JOIN m{k} AS m ON m.p = c.p AND m.i = c.i)"""
    steps = ",".join(assign.format(k=k) + ("," + move.format(k=k, n=k + 1) if k < rounds else "") for k in range(rounds + 1))
    return f"""
        WITH x AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, embedding AS e, len(embedding) // 16 AS w FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0
        ),
        y AS MATERIALIZED (SELECT id, p, [floor(256 * z::DOUBLE)::BIGINT FOR z IN e[p * w + 1 : (p + 1) * w]] AS v FROM x, unnest(range(16)) AS u(p)),
        c0 AS (SELECT p, id - 1 AS i, v FROM y WHERE id <= 64),{steps},
        r AS (SELECT id, string_agg(printf('%02x', i), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY id),
        h AS (SELECT sha256(string_agg(v[j]::VARCHAR, ',' ORDER BY p, i, j)) AS h FROM c{rounds}, unnest(range(1, len(v) + 1)) AS u(j))
        SELECT x.vec_id, r.code, r.error, (sum(r.error) OVER (PARTITION BY x.label))::BIGINT AS label_error, h.h AS codebooks_sha256 FROM x JOIN r USING (id), h
    """


ORACLE_SQL = {
    "op12_vector_codes": _codes_sql(),
    "op4_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op11_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
        k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
        l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
        g AS (SELECT h.lang, h.source, coalesce(sum(c.n) FILTER (k.kept IS NOT NULL), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) AS h LEFT JOIN c ON c.lang = h.lang AND c.source = h.source LEFT JOIN (SELECT lang, term, 1 AS kept FROM k) AS k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
        f AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v)::HUGEINT AS p,
                1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v)::HUGEINT AS q
            FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
            FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (
                SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
                FROM f AS x JOIN f AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
            ) AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM f WHERE n > 0 AND p > q),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
        )
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
}
