"""Queries of job ledgers, caches, providers, requests and reports. Columns of events, lineitem and conversations stand in for a studio's own."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from cantora.functions import fixed as X
from cantora.functions import text as T
from cantora.operators import curate, ledger, signal
from cantora.registry import query, table

_NOW = datetime.datetime(2024, 1, 15, 12)
_LIT = lambda x: "'" + x.replace("'", "''") + "'"
_LIST = lambda xs: "[" + ", ".join(map(_LIT, xs)) + "]"


@query("SELECT 'tts' AS stage, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'click') AS click, count(*) AS total FROM events UNION ALL SELECT 'rvc', count(*) FILTER (value <= 20), count(*) FILTER (value > 20), count(*) FROM events")
def ledger_pivot(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("tts"), F.when(F.col("value") > 20, "click").otherwise("error").alias("rvc"))
    return ledger.pivoted(rows, ["tts", "rvc"], ["error", "click"]).select("stage", "error", "click", "total")


@query("SELECT l_orderkey AS chapter, list_sort(list(printf('chapter_%02d/chunk_%04d', l_orderkey, l_linenumber))) AS cids FROM lineitem GROUP BY 1")
def chapter_chunks(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chapter"), F.format_string("chapter_%02d/chunk_%04d", "l_orderkey", "l_linenumber").alias("cid"))
    return ledger.chapters(rows, "chapter", "cid").orderBy("chapter")


@query("WITH c AS (SELECT sha1(role || '|+0%|' || text)[:24] AS key, length(text) * 10 AS bytes, CASE WHEN turn % 2 = 0 THEN 'mms' END AS engine FROM conversations WHERE turn % 3 = 0 AND text IS NOT NULL), h AS (SELECT key, max(coalesce(engine, 'edge')) AS engine FROM c WHERE bytes > 600 GROUP BY key) SELECT conv_id, turn, h.engine, h.key IS NOT NULL AS hit FROM conversations x LEFT JOIN h ON h.key = sha1(role || '|+0%|' || text)[:24] WHERE text IS NOT NULL")
def cache_probe(spark, d):
    rows = table(spark, d, "conversations").filter("text IS NOT NULL").withColumn("key", T.unit_key(F.col("role"), F.lit("+0%"), F.col("text")))
    held = rows.filter("turn % 3 = 0").select("key", (F.length("text") * 10).alias("bytes"), F.when(F.col("turn") % 2 == 0, "mms").alias("engine"))
    return ledger.probe(rows.select("conv_id", "turn", "key"), held, "key").drop("key")


_PROGRESS = "p AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 15 AS done, 4000 AS total FROM events)"


@query(f"WITH {_PROGRESS}, f AS (SELECT *, first_value(ts) OVER w AS t0, first_value(done) OVER w AS d0 FROM p WHERE done >= 60 AND total > done WINDOW w AS (PARTITION BY user_id ORDER BY ts, done)), l AS (SELECT event_id, (total - done) * ((epoch_us(ts) - epoch_us(t0)) / 1e6 / (done - d0)) AS s FROM f WHERE done - d0 >= 25 AND epoch_us(ts) - epoch_us(t0) >= 5000000), n AS (SELECT event_id, s FROM l WHERE s >= 45) SELECT p.event_id, done, round_even(s, 3) AS left_s, CASE WHEN s < 5400 THEN printf('about %d min left', greatest(1, round_even(s / 60, 0)::INT)) WHEN s IS NOT NULL THEN printf('about %.1f h left', s / 3600) END AS note FROM p LEFT JOIN n USING (event_id)")
def time_left(spark, d):
    from pyspark.sql import Window as W

    rows = table(spark, d, "events").select("user_id", "event_id", "ts", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) * 15).alias("done"), F.lit(4000).alias("total"))
    return ledger.eta(rows, "user_id", "ts", "done", "total").select("event_id", F.col("done").cast("long").alias("done"), F.bround("left_s", 3).alias("left_s"), "note")


_WORDS = {"the": "THE", "there": "yonder", "an": "one", "and": "&", "th": "T"}


def _replaced_sql(c: str) -> tuple[str, str]:
    n = "0"
    for w in sorted(_WORDS, key=len, reverse=True):
        n += f" + (length({c}) - length(replace({c}, '{w}', ''))) // {len(w)}"
        c = f"replace({c}, '{w}', '{_WORDS[w]}')"
    return c, n


@query("SELECT doc_id, md5({}) AS fixed_md5, ({})::INT AS fixes FROM documents".format(*_replaced_sql("text")))
def word_fixes(spark, d):
    fixed, n = T.replaced(F.col("text"), _WORDS)
    return table(spark, d, "documents").select("doc_id", F.md5(fixed).alias("fixed_md5"), n.cast("int").alias("fixes"))


@query("SELECT conv_id, turn, len(regexp_extract_all(text, 'there|the|and|an|th'))::INT AS terms, regexp_extract(text, 'there|the|and|an|th') AS first FROM conversations")
def longest_terms(spark, d):
    pattern = T.longest_first(list(_WORDS))
    return table(spark, d, "conversations").select("conv_id", "turn", F.regexp_count("text", F.lit(pattern)).alias("terms"), F.regexp_extract("text", pattern, 0).alias("first"))


@query("SELECT doc_id, source, more FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, greatest(0, count(*) OVER (PARTITION BY source) - 40) AS more FROM documents) WHERE r <= 40 AND source IS NOT NULL")
def first_skipped(spark, d):
    return curate.listed(table(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"], 40)


_ENGINES = ", ".join(f"({_LIT(e)}, {q}, {o})" for e, q, o in X.ENGINES)


@query(f"SELECT engine, quality, offline, coalesce(list_position({_LIST(X.ENGINE_ORDER)}, engine), 0)::INT AS tried FROM (VALUES {_ENGINES}) v(engine, quality, offline)")
def engine_table(spark, d):
    rows = spark.createDataFrame([(e, q, o) for e, q, o in X.ENGINES], "engine string, quality int, offline boolean")
    return rows.withColumn("tried", F.array_position(F.array(*map(F.lit, X.ENGINE_ORDER)), F.col("engine")).cast("int")).orderBy(F.desc("quality"))


_TRIES = f"t AS (SELECT DISTINCT user_id, (event_id // 5) AS request, ({_LIST(X.ENGINE_ORDER)})[event_id % 5 + 1] AS engine, event_id % 5 + 1 AS p, value > 60 AS ok FROM events)"


@query(f"WITH {_TRIES}, b AS (SELECT request, min(p) FILTER (ok) AS best FROM t GROUP BY request) SELECT request, best IS NOT NULL AS ok, ({_LIST(X.ENGINE_ORDER)})[best] AS engine, coalesce((SELECT list(({_LIST(X.ENGINE_ORDER)})[q] ORDER BY q) FROM (SELECT DISTINCT p AS q FROM t WHERE t.request = b.request AND (best IS NULL OR p < best))), []) AS tried FROM b")
def provider_chain(spark, d):
    engine = F.get(F.array(*map(F.lit, X.ENGINE_ORDER)), (F.col("event_id") % 5).cast("int"))
    rows = table(spark, d, "events").select(F.floor(F.col("event_id") / 5).alias("request"), engine.alias("engine"), (F.col("value") > 60).alias("ok"))
    return ledger.first_success(rows, "request", "engine", "ok", X.ENGINE_ORDER)


_HELD = "epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts) <= {}"


@query(f"SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE {_HELD.format('1209600000000')}) WHERE r <= 30")
def audio_cache(spark, d):
    return ledger.evict(table(spark, d, "events").select("event_id", "event_type", "ts"), ["event_type"], "ts", "event_id", _NOW, 14 * 86400, F.lit(1), 30).drop("ts")


@query(f"SELECT event_id, event_type FROM (SELECT *, sum(event_id % 1000) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events WHERE {_HELD.format('604800000000')}) WHERE s <= 20000")
def unit_cache(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "ts")
    return ledger.evict(rows, ["event_type"], "ts", "event_id", _NOW, 7 * 86400, F.col("event_id") % 1000, 20000).drop("ts")


@query("SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS value, min(ts) AS ts FROM events GROUP BY ALL")
def first_definitions(spark, d):
    return ledger.first_of_kind(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value", "ts"])


@query("SELECT vec_id // 8 AS clip, count(*)::INT * 64 AS n, round_even(list_sum([x::DOUBLE * i for x, i in flatten(list(embedding ORDER BY vec_id))]), 4) AS turned FROM embeddings GROUP BY 1")
def joined_clips(spark, d):
    parts = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("clip"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    got = curate.joined_parts(parts, "clip", ["vec_id"], "x")
    return got.select("clip", F.size("x").alias("n"), F.bround(F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 4).alias("turned"))


@query("SELECT DISTINCT lang, lower(w) AS word FROM (SELECT lang, unnest(regexp_extract_all(text, '[\\p{L}]+')) AS w FROM documents)")
def distinct_words(spark, d):
    words = table(spark, d, "documents").select("lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)))).alias("w"))
    return words.select("lang", F.lower("w").alias("word")).distinct()


@query("SELECT conv_id, count(*) AS units, sum(length(text))::BIGINT AS chars, count(*) <= 40000 AND sum(length(text)) <= 8000000 AS ok FROM conversations GROUP BY conv_id")
def episode_limits(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("units"), F.sum(F.length("text")).alias("chars"))
    return rows.withColumn("ok", T.within_limits(F.col("units"), F.col("chars")))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'lines required' WHEN event_id % 5 = 0 THEN 'each line needs a non-empty text string' WHEN event_id % 3 = 0 THEN 'job id required (16-64 chars)' WHEN event_type = 'click' THEN 'format must be mp3 or wav' END AS reason FROM events")
def request_reasons(spark, d):
    e = F.col("event_id")
    job = F.when(e % 3 == 0, F.concat(F.lit("job "), e.cast("string"))).otherwise(F.concat(F.lit(" "), F.md5(e.cast("string")), F.lit(" ")))
    lines = F.when(e % 7 == 0, F.array().cast("array<string>")).when(e % 5 == 0, F.array(F.lit("a"), F.lit(" \n"))).otherwise(F.array(F.lit("a line")))
    fmt = F.when(F.col("event_type") == "click", "ogg").when(F.col("event_type") == "error", "WAV")
    return table(spark, d, "events").select("event_id", T.asked(job, fmt, lines).alias("reason"))


@query("SELECT x.doc_id, CASE WHEN NOT regexp_matches(coalesce(k, ''), '[\\x{1780}-\\x{17FF}]') THEN 'no Khmer script in the text' WHEN length(k) < 2 THEN 'text too short' WHEN x.doc_id % 11 = 0 THEN 'could not convert audio' WHEN x.doc_id % 13 = 0 THEN 'unreadable wav' WHEN n_chars / 100.0 < 1 THEN 'too short' WHEN n_chars / 100.0 > 20 THEN 'too long' WHEN x.doc_id % 17 / 1000.0 < 0.002 THEN 'almost silent' END AS reason FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'ក' ELSE 'កខ ' || text END AS k FROM documents) x")
def pair_gate(spark, d):
    i = F.col("doc_id")
    k = F.when(i % 4 == 0, F.col("text")).when(i % 4 == 1, "ក").otherwise(F.concat(F.lit("កខ "), F.col("text")))
    return table(spark, d, "documents").select("doc_id", curate.pair_reason(k, i % 11 != 0, F.when(i % 13 != 0, F.col("n_chars") / 100.0), i % 17 / 1000.0).alias("reason"))


@query("SELECT p_partkey, CASE WHEN upper(name[:2]) IN ('G_', 'D_') OR regexp_matches(lower(name), 'train|checkpoint') OR size >= 157286400 THEN 'checkpoint' WHEN size >= 5242880 THEN 'maybe' ELSE 'unknown' END AS verdict FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'g_' ELSE '' END || 'voice' || CASE p_partkey % 7 WHEN 0 THEN '-Train' ELSE '' END || '.pth' AS name, p_partkey * 1000000 AS size FROM part)")
def model_files(spark, d):
    i = F.col("p_partkey")
    name = F.concat(F.when(i % 5 == 0, "g_").otherwise(""), F.lit("voice"), F.when(i % 7 == 0, "-Train").otherwise(""), F.lit(".pth"))
    return table(spark, d, "part").select("p_partkey", curate.model_verdict(name, i * 1000000).alias("verdict"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '?' ELSE (['40k', '48k', '32k'])[event_id % 3 + 1] END AS sr, CASE WHEN event_id % 4 > 0 THEN 200 + (event_id % 9)::INT END AS epochs, 'v2' AS version, '?' AS f0, (event_id % 50 + 3)::INT AS seen, event_id % 2 = 0 AS completed FROM events")
def training_runs(spark, d):
    e = F.col("event_id")
    log = F.concat_ws("\n", F.lit("-v v1 -v v2"), F.concat(F.lit("-sr "), F.get(F.array(F.lit(""), F.lit("48000"), F.lit("32k")), (e % 3).cast("int"))), F.when(e % 4 > 0, F.format_string("-te %d", 200 + e % 9)), F.format_string("Epoch: %d\nepoch=%d", e % 50, e % 50 + 3), F.when(e % 2 == 0, "All processes have been completed!"))
    return table(spark, d, "events").select("event_id", curate.training_run(log).alias("r")).select("event_id", "r.*")


_SAMPLES = "s AS (SELECT vec_id AS id, vec_id % 3 = 1 AS bad, CASE vec_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['Nothing to do'] WHEN 2 THEN ['hum @ 45', 'hiss'] ELSE ['room @ 2'] END AS st, 100.0::DOUBLE + vec_id % 20 AS a, 101.5::DOUBLE + vec_id % 7 AS b, vec_id % 19 / 10.0 AS ltas FROM embeddings)"


@query(f"WITH {_SAMPLES}, m AS (SELECT *, len(st) = 0 OR (len(st) = 1 AND contains(lower(st[1]), 'nothing')) AS idle, abs(b - a) / a * 100 AS f0 FROM s) SELECT count(*) FILTER (NOT bad) AS clean, count(*) FILTER (bad) AS damaged, count(*) FILTER (NOT bad AND idle) AS untouched, (SELECT list_sort(list(DISTINCT trim(split_part(x, '@', 1)))) FROM (SELECT unnest(st) AS x FROM m WHERE NOT bad AND NOT idle)) AS moves, round_even(max(f0) FILTER (NOT bad), 6) AS clean_f0, round_even(max(f0) FILTER (bad), 6) AS damaged_f0, arg_max(id, (ltas, -id)) FILTER (NOT bad) AS clean_most, arg_max(id, (ltas, -id)) FILTER (bad) AS damaged_most FROM m")
def sample_matrix(spark, d):
    i = F.col("vec_id")
    stages = F.when(i % 4 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.array(F.lit("Nothing to do"))).when(i % 4 == 2, F.array(F.lit("hum @ 45"), F.lit("hiss"))).otherwise(F.array(F.lit("room @ 2")))
    f0 = F.concat((100.0 + i % 20).cast("string"), F.lit(" → "), (101.5 + i % 7).cast("string"), F.lit(" Hz"))
    rows = table(spark, d, "embeddings").select(i.alias("id"), F.when(i % 3 == 1, "hiss").otherwise("").alias("damage"), stages.alias("stages"), f0.alias("f0"), (i % 19 / 10.0).alias("ltas"))
    return curate.matrix_summary(rows).withColumns({c: F.bround(c, 6) for c in ("clean_f0", "damaged_f0")})


@query("SELECT event_id, ([20, 30, 45, 60, 90, 120, 180, 300])[least(a, 8)] AS wait_s, 3.0::DOUBLE * a AS linear_s, (list_sum([([20, 30, 45, 60, 90, 120, 180, 300])[least(i, 8)] for i in range(1, a)]))::INT AS waited_s, coalesce(list_sum([([20, 30, 45, 60, 90, 120, 180, 300])[least(i, 8)] for i in range(1, a)]), 0) <= 2700 AS patient FROM (SELECT event_id, (event_id % 30 + 2)::INT AS a FROM events)")
def retry_waits(spark, d):
    a = (F.col("event_id") % 30 + 2).cast("int")
    return table(spark, d, "events").select("event_id", ledger.backoff(a).alias("wait_s"), ledger.linear_backoff(a.cast("double")).alias("linear_s"), ledger.waited(a).cast("int").alias("waited_s"), (ledger.waited(a) <= ledger.PATIENCE_S).alias("patient"))


@query("SELECT event_id, coalesce(epoch_us(ts) - max(CASE WHEN event_type = 'error' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 7200000000, false) AS open FROM events")
def open_breakers(spark, d):
    rows = table(spark, d, "events").withColumn("refused", F.col("event_type") == "error")
    return ledger.breaker(rows, "user_id", "ts", "event_id", "refused", 7200).select("event_id", "open")


@query("WITH RECURSIVE g AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, value > 60 AS f FROM events), r AS (SELECT user_id, i, CASE WHEN f THEN 3 ELSE 6 END AS w FROM g WHERE i = 1 UNION ALL SELECT g.user_id, g.i, CASE WHEN f THEN greatest(1, r.w // 2) ELSE least(6, r.w * 2) END FROM r JOIN g ON g.user_id = r.user_id AND g.i = r.i + 1) SELECT user_id, list(w ORDER BY i) AS widths FROM r GROUP BY user_id")
def batch_widths(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") > 60).alias("f")))), lambda x: x["f"]).alias("g"))
    return rows.select("user_id", ledger.width(F.col("g")).alias("widths"))


@query("WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, min(ts) AS since FROM events GROUP BY user_id) SELECT user_id, row_number() OVER (ORDER BY since, user_id) AS position FROM l WHERE state NOT IN ('purchase', 'signup')")
def resumed_jobs(spark, d):
    return ledger.pending(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type", ["purchase", "signup"]).select("user_id", F.col("position").cast("long").alias("position"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, min(CASE WHEN l_discount > 0.08 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS gap FROM lineitem) WHERE gap IS NULL OR l_linenumber < gap")
def ready_lines(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") <= 0.08).alias("ready"))
    return ledger.prefix_ready(rows, "l_orderkey", "l_linenumber", "ready").drop("ready")


@query("WITH f AS (SELECT doc_id AS stem, k AS dir FROM documents, (VALUES ('wavs', 2), ('wav', 3), ('', 5)) v(k, m) WHERE doc_id % m = 0) SELECT l.doc_id AS stem, l.quality, arg_min(f.dir, list_position(['wavs', 'wav', ''], f.dir)) AS dir FROM labels l JOIN f ON f.stem = l.doc_id GROUP BY ALL")
def indexed_clips(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("stem"))
    kinds = spark.createDataFrame([("wavs", 2), ("wav", 3), ("", 5)], "dir string, m int")
    files = docs.join(F.broadcast(kinds), F.expr("stem % m = 0")).select("stem", "dir")  # 3 rows
    return curate.first_match(table(spark, d, "labels").select(F.col("doc_id").alias("stem"), "quality"), files, "stem", "dir", ["wavs", "wav", ""])


_LABEL = lambda t: f"({t} IS NOT NULL AND regexp_matches({t}, '^[\\p{{L}}\\p{{N}} _-]{{1,4}}$') AND NOT regexp_matches({t}, '[\\x{{1780}}-\\x{{17FF}}]'))"


@query(f"SELECT conv_id, turn, i::INT AS i, {_LABEL('role')} AS role_label, {_LABEL('t')} AS field_label FROM (SELECT *, regexp_replace(f, '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT conv_id, turn, role, generate_subscripts(fs, 1) - 1 AS i, unnest(fs) AS f FROM (SELECT *, regexp_split_to_array(text, '[,.:]') AS fs FROM conversations)))")
def speaker_labels(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "[,.:]")).alias("i", "f"))
    return rows.select("conv_id", "turn", "i", T.speaker_label(F.col("role")).alias("role_label"), T.speaker_label(F.col("f")).alias("field_label"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?\\s*%'))::INT AS percent, len(regexp_extract_all(text, '(?i)(\\$|\\x{17DB}|\\briel)\\s*[0-9]'))::INT AS currency, len(regexp_extract_all(text, '[\\x{17E0}-\\x{17E9}]'))::INT AS khmer_digits FROM documents")
def number_signs(spark, d):
    n = T.number_signs(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[n[c].alias(c) for c in ("percent", "currency", "khmer_digits")])


@query("SELECT vec_id, greatest(0.5, least(1.5, x)) AS speed, greatest(0, least(2, x)) AS pause, greatest(0, least(1, x)) AS bed, greatest(0.5, least(2, x)) AS bed_speed, greatest(0.75, least(1.35, x)) AS pace FROM (SELECT vec_id, embedding[1]::DOUBLE * 10 AS x FROM embeddings)")
def clamped_settings(spark, d):
    from cantora.functions.numbers import clamp

    x = F.get("embedding", F.lit(0)).cast("double") * 10
    limits = {"speed": (0.5, 1.5), "pause": (0.0, 2.0), "bed": (0.0, 1.0), "bed_speed": (0.5, 2.0), "pace": (0.75, 1.35)}
    return table(spark, d, "embeddings").select("vec_id", *[clamp(x, *at).alias(c) for c, at in limits.items()])


@query("SELECT vec_id, round_even(0.85::DOUBLE / p, 6) AS gain, round_even(list_max([abs(greatest(-1, least(1, a[i] * (0.85::DOUBLE / p) + 0.3::DOUBLE * a[(i - 1) % 16 + 1]))) for i in range(1, len(a) + 1)]), 6) AS peak FROM (SELECT vec_id, [x::DOUBLE for x in embedding] AS a, list_max([abs(x::DOUBLE) for x in embedding]) AS p FROM embeddings)")
def bed_mix(spark, d):
    a = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", a.alias("a"))
    mixed = signal.bed_mix(F.col("a"), F.slice("a", 1, 16), 0.3)
    return rows.select("vec_id", F.bround(0.85 / signal.peak(F.col("a")), 6).alias("gain"), F.bround(signal.peak(mixed), 6).alias("peak"))
