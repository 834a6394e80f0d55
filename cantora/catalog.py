"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cantora import oracle as O
from cantora.functions import fixed as X
from cantora.functions import numbers as N
from cantora.functions import segment as S
from cantora.functions import speech
from cantora.functions import text as T
from cantora.operators import curate, ledger, percentiles, quality, signal
from cantora.plans import dialogue, reading
from cantora.plans import performance as P
from cantora.registry import ORACLE_SQL, QUERIES, query, table  # noqa: F401
from cantora.streaming import jobs


@query(O.TEXT_PROFILE)
def text_profile(spark, d):
    c = F.col("text")
    # by doc_id: a file has few row groups, and a text is searched a dozen times
    return table(spark, d, "documents").select("doc_id", "text", "lang").repartition("doc_id").select("doc_id", T.is_script(c, T.KHMER).alias("khmer"), T.is_script(c, T.THAI).alias("thai"), T.route(c).alias("route"), T.route(c, F.col("lang")).alias("read_in"), T.speakable(c).alias("speakable"), T.word_count(c).alias("words"), T.topic(c).alias("topic"))


@query(O.CLEAN_TEXT)
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("clean_md5"), T.unit_key(F.lit("v1"), F.lit("+0%"), F.col("text")).alias("unit_key"))


@query(O.MANUSCRIPT)
def manuscript_lines(spark, d):
    lines = table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("pos", "line"))
    return lines.select("page_id", "pos", T.manuscript(F.col("line")).alias("said")).filter("said != ''")


@query(O.UNITS + "SELECT doc_id, pos, text, boundary FROM units")
def sentence_units(spark, d):
    return P.units(table(spark, d, "documents")).drop("last")


@query(O.BATCH_SENTENCES)
def batch_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(S.batch_sentences(F.col("text"))).alias("pos", "sentence"))


@query(O.DIALOGUE_SENTENCES)
def dialogue_sentences(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(S.dialogue_sentences(F.col("text"))).alias("pos", "sentence"))


@query(O.CHUNKS)
def sentence_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(S.chunk_sentences(S.batch_sentences(F.col("text")))).alias("pos", "chunk")).select("doc_id", F.format_string("chunk_%04d", F.col("pos") + 1).alias("cid"), "chunk")


@query(O.CHAPTERS)
def chapter_bodies(spark, d):
    return S.chapters(table(spark, d, "documents")).select("doc_id", "num", "title", F.md5("body").alias("body_md5"))


@query(O.SCRIPT_LINES)
def script_lines(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(S.script_lines(F.col("text"))).alias("pos", "l")).select("conv_id", "turn", "pos", "l.s", "l.text")


@query(O.SAMPLED)
def sampled_facts(spark, d):
    facts = S.dialogue_sentences(F.col("text"))
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.bround(i * (F.size("facts") - 1) / 7.0, 0).cast("int")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", facts.alias("facts")).filter("size(facts) > 0")
    return rows.select("conv_id", "turn", F.posexplode(F.when(F.size("facts") <= 8, F.col("facts")).otherwise(F.transform(at, lambda i: F.get("facts", i)))).alias("pos", "fact"))


@query(O.ANALYSE + "SELECT doc_id, style, pos, emotion, intensity, words, is_dialogue FROM analysed")
def analyse(spark, d):
    return P.analyse(P.units(table(spark, d, "documents")), spark, ["documentary", "cinematic", "news"]).select("doc_id", "style", "pos", "emotion", "intensity", "words", "is_dialogue")


@query(O.ANALYSE + "SELECT doc_id, count(*) AS sentences, round_even(sum(intensity)::DOUBLE / count(*), 4) AS mean_intensity, arg_min(emotion, (-n, emotion)) AS emotion FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, emotion) AS n FROM analysed WHERE style = 'documentary') GROUP BY doc_id")
def doc_intensity(spark, d):
    rows = P.analyse(P.units(table(spark, d, "documents")), spark, ["documentary"]).groupBy("doc_id", "emotion").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("s"))
    return rows.groupBy("doc_id").agg(F.sum("n").alias("sentences"), F.bround(F.sum("s") / F.sum("n"), 4).alias("mean_intensity"), F.min_by("emotion", F.struct(-F.col("n"), "emotion")).alias("emotion"))


@query(O.PLAN + "SELECT doc_id, style, pos, emotion, intensity, words, 0.0::DOUBLE AS pitch_st, rate, gain_db, pause_s, pre_pause_ms, ending, is_dialogue, fear, breaking, suspended, delivery FROM plan")
def performance_plan(spark, d):
    return P.plan(table(spark, d, "documents"), only=O.PLAN_STYLES).drop("boundary", "speaker", "chars", "stressed")


@query(O.PLAN + "SELECT style, count(*) AS n, min(intensity) AS lo, max(intensity) AS hi, list_sort(list(DISTINCT emotion)) AS emotions, round_even(avg(rate), 3) AS rate FROM plan GROUP BY style")
def plan_summary(spark, d):
    return P.plan(table(spark, d, "documents"), only=O.PLAN_STYLES).groupBy("style").agg(F.count(F.lit(1)).alias("n"), F.min("intensity").alias("lo"), F.max("intensity").alias("hi"), F.array_sort(F.collect_set("emotion")).alias("emotions"), F.bround(F.avg("rate"), 3).alias("rate"))


@query(O.PLAN + O.TIMELINE)
def plan_timeline(spark, d):
    rows = P.timeline(P.plan(table(spark, d, "documents"), only=O.PLAN_STYLES))
    return rows.select("doc_id", "style", "pos", F.bround("gap", 3).alias("gap"), F.bround("start", 3).alias("start"))


@query(O.PLAN + "SELECT style, delivery, count(*) AS n, count(*) FILTER (WHERE fear) AS fearful, count(*) FILTER (WHERE breaking) AS breaking, count(*) FILTER (WHERE suspended) AS suspended, round_even(avg(pause_s), 3) AS pause_s FROM plan GROUP BY style, delivery")
def delivery_summary(spark, d):
    rows = P.plan(table(spark, d, "documents"), only=O.PLAN_STYLES).groupBy("style", "delivery")
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(n) for c, n in (("fear", "fearful"), ("breaking", "breaking"), ("suspended", "suspended"))], F.bround(F.avg("pause_s"), 3).alias("pause_s"))


@query(O.FEELINGS)
def feelings(spark, d):
    found = P.feelings(F.col("hits"))
    return P.units(table(spark, d, "documents")).withColumn("hits", P.cues(F.col("text"))).select("doc_id", "pos", found.alias("found")).select("*", P.auto_emotion(F.col("found"), "documentary").alias("emotion"))


@query(O.plan_sql([s[0] for s in X.STYLES]) + "SELECT doc_id, style, pos, emotion, intensity, rate, gain_db, pause_s, pre_pause_ms, delivery FROM plan")
def performance_plan_all_styles(spark, d):
    return P.plan(table(spark, d, "documents")).select("doc_id", "style", "pos", "emotion", "intensity", "rate", "gain_db", "pause_s", "pre_pause_ms", "delivery")


def _spoken(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", F.col("role").alias("speaker"))


@query(O.plan_sql(["storytelling", "thriller"], O.SPOKEN) + "SELECT doc_id, style, pos, rate, gain_db, pause_s, pre_pause_ms FROM plan")
def dialogue_plan(spark, d):
    return P.plan(_spoken(spark, d), only=["storytelling", "thriller"]).select("doc_id", "style", "pos", "rate", "gain_db", "pause_s", "pre_pause_ms")


@query(O.plan_sql(["storytelling"], O.SPOKEN) + O.DIALOGUE_TIMELINE)
def dialogue_timeline(spark, d):
    rows = P.plan(_spoken(spark, d), only=["storytelling"]).withColumn("conv_id", F.floor(F.col("doc_id") / 1000))
    rows = P.timeline(rows, piece=("conv_id",), order=("doc_id", "pos"))
    return rows.select("conv_id", "doc_id", "pos", F.bround("gap", 3).alias("gap"), F.bround("start", 3).alias("start"))


@query(O.NUMBERS)
def spoken_numbers(spark, d):
    n = F.col("l_orderkey") * 137 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(n.alias("n")).distinct().select("n", T.number_words(F.col("n")).alias("words"), T.ordinal_words(F.col("n") % 1000).alias("ordinal"), T.digit_words(F.col("n").cast("string")).alias("digits"), T.rate_percent((F.col("n") % 100) / 50.0).alias("rate"), T.clock(F.col("n") % 5000).alias("clock"))


@query(O.STYLE_IDS)
def style_ids(spark, d):
    names = [*(s[0] for s in X.STYLES), *X.STYLE_ALIASES, "News-Anchor", " Thriller ", "no such style"]
    alias = F.create_map(*[F.lit(x) for kv in {**{s[0]: s[0] for s in X.STYLES}, **X.STYLE_ALIASES}.items() for x in kv])
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    plain = F.lower(F.trim("name"))
    return rows.select("name", F.coalesce(F.try_element_at(alias, plain), F.try_element_at(alias, F.translate(plain, "-", "_")), F.lit("natural")).alias("style"))


# -- ledgers on events: event_type as status, user_id as job --------------------------------------------------------


@query("SELECT stage, status, count(*) AS n FROM (SELECT 'tts' AS stage, event_type AS status FROM events UNION ALL SELECT 'rvc', CASE WHEN value > 50 THEN 'success' ELSE 'failed' END FROM events) WHERE status IS NOT NULL GROUP BY 1, 2")
def ledger_counts(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("tts"), F.when(F.col("value") > 50, "success").otherwise("failed").alias("rvc"))
    return ledger.counts(rows, ["tts", "rvc"])


@query("SELECT user_id, count(*) AS total, count(*) FILTER (WHERE NOT (event_type <> 'error')) AS failed, count(*) FILTER (WHERE event_id % 3 + 1 > 1) AS retried, bool_and(event_type <> 'error') AS passed FROM events GROUP BY user_id")
def production_report(spark, d):
    rows = table(spark, d, "events").select("user_id", (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 3 + 1).alias("attempts"))
    return ledger.report(rows, "user_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING bool_and(value > 0.5)")
def complete_jobs(spark, d):
    return ledger.complete_groups(table(spark, d, "events").withColumn("ok", F.col("value") > 0.5), "user_id", "ok")


@query("SELECT l.doc_id, l.quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = l.doc_id AND x.lang = 'en')")
def stale_rows(spark, d):
    return ledger.stale(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").filter("lang = 'en'"), "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def gated_rows(spark, d):
    return ledger.gated(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").filter("quality = 1"), "doc_id")


@query("SELECT coalesce(l.doc_id, x.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN x.lang WHEN l.quality = 1 THEN 'kept' END AS state FROM labels l FULL OUTER JOIN documents x ON l.doc_id = x.doc_id")
def resumed_rows(spark, d):
    log = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "kept").alias("state"))
    return ledger.resume(log, table(spark, d, "documents").select("doc_id", F.col("lang").alias("state")), "doc_id", ["state"])


@query("SELECT user_id, arg_max(CASE WHEN value > 20 THEN event_type END, (ts, event_type)) FILTER (WHERE value > 20) AS status, arg_max(value, (ts, value)) AS value FROM events GROUP BY user_id")
def latest_status(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", F.when(F.col("value") > 20, F.col("event_type")).alias("status"), "value")
    return ledger.latest(rows, "user_id", "ts", ["status", "value"])


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position FROM events")
def queue_positions(spark, d):
    return ledger.queue_position(table(spark, d, "events").select("event_id", "event_type", "ts"), "event_type", "ts", "event_id").drop("ts")


@query("SELECT event_id, user_id, s AS silence_s FROM (SELECT event_id, user_id, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE s > 420")
def stalled_jobs(spark, d):
    return ledger.stalls(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "silence_s")


@query("WITH a AS (SELECT user_id, value > 30 AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spot FROM events), b AS (SELECT user_id, spot, spot - row_number() OVER (PARTITION BY user_id ORDER BY spot) AS island FROM a WHERE f) SELECT user_id, island, count(*) AS length, min(spot) AS first_at, max(spot) AS last_at FROM b GROUP BY ALL HAVING count(*) >= 3")
def breaker_islands(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") > 30).alias("f"))
    return ledger.islands(rows, "user_id", ["ts", "event_id"], "f").filter("length >= 3")


@query(O.BATCHES)
def clone_batches(spark, d):
    return ledger.batches(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], "value", 16, 450.0)


@query("SELECT * FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS held FROM documents) WHERE held <= 100000")
def cache_eviction(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return ledger.running(docs, ["source"], -F.floor(F.col("doc_id") / 65536), [F.desc("doc_id")], F.col("n_chars"), "held").filter("held <= 100000").drop("n_chars")


@query("SELECT time_bucket(INTERVAL '1 minute', ts) AS start, count(*) AS n, max(value) AS peak FROM events GROUP BY 1")
def minute_totals(spark, d):
    return jobs.minutes(table(spark, d, "events"), "value")


@query("WITH a AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 420000000, true)::INT AS new FROM events), b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS beats FROM b GROUP BY user_id, s")
def heartbeat_sessions(spark, d):
    return jobs.sessions(table(spark, d, "events"), "user_id")


# -- curation --------------------------------------------------------------------------------------------------------


@query("SELECT x.doc_id, CASE WHEN x.text IS NULL THEN 'no script' WHEN length(x.text) < 40 THEN 'short' WHEN l.quality = 0 THEN 'quality' WHEN l.toxic = 1 THEN 'toxic' WHEN length(x.text) > 20000 THEN 'long' END AS reason FROM documents x LEFT JOIN labels l ON x.doc_id = l.doc_id")
def training_gate(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    n = F.length("text")
    return rows.select("doc_id", curate.reason((F.col("text").isNull(), "no script"), (n < 40, "short"), (F.col("quality") == 0, "quality"), (F.col("toxic") == 1, "toxic"), (n > 20000, "long")).alias("reason"))


@query("SELECT source, count(*) AS clips, round_even(sum(n_chars) / 9.0 / 60, 2) AS minutes, CASE WHEN sum(n_chars) / 540.0 >= 30 THEN 'excellent' WHEN sum(n_chars) / 540.0 >= 10 THEN 'good' WHEN sum(n_chars) / 540.0 >= 5 THEN 'usable' ELSE 'too little' END AS verdict FROM documents GROUP BY source")
def dataset_rollup(spark, d):
    rows = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("clips"), F.sum("n_chars").alias("chars"))
    return rows.select("source", "clips", F.bround(F.col("chars") / 9.0 / 60, 2).alias("minutes"), curate.verdict(F.col("chars") / 540.0).alias("verdict"))


@query("WITH f AS (SELECT doc_id AS stem, k AS ext FROM documents, (VALUES ('.wav', 2), ('.mp3', 3), ('.flac', 5)) v(k, m) WHERE doc_id % m = 0) SELECT l.doc_id AS stem, l.quality, arg_min(f.ext, list_position(['.wav', '.mp3', '.m4a', '.flac', '.ogg'], f.ext)) AS ext FROM labels l JOIN f ON f.stem = l.doc_id GROUP BY ALL")
def paired_clips(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("stem"))
    kinds = spark.createDataFrame([(".wav", 2), (".mp3", 3), (".flac", 5)], "ext string, m int")
    files = docs.join(F.broadcast(kinds), F.expr("stem % m = 0")).select("stem", "ext")  # 3 rows
    texts = table(spark, d, "labels").select(F.col("doc_id").alias("stem"), "quality")
    return curate.first_match(texts, files, "stem", "ext", [".wav", ".mp3", ".m4a", ".flac", ".ogg"])


# -- signals; embeddings stand in for frames of samples, and are not audio --------------------------------------------


@query("SELECT vec_id, round_even(list_max(a), 6) AS peak, round_even(r, 6) AS rms, round_even(20 * log10(r), 3) AS dbfs, round_even(list_sort(a)[floor(len(a) * 0.1)::INT + 1], 6) AS floor FROM (SELECT vec_id, a, sqrt(list_sum([x * x for x in a]) / len(a)) AS r FROM (SELECT vec_id, [abs(x::DOUBLE) for x in embedding] AS a FROM embeddings))")
def frame_levels(spark, d):
    a = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", F.bround(signal.peak(F.col("embedding")), 6).alias("peak"), F.bround(signal.rms(F.col("embedding")), 6).alias("rms"), F.bround(signal.dbfs(signal.rms(F.col("embedding"))), 3).alias("dbfs"), F.bround(signal.floor_value(a), 6).alias("floor"))


@query("SELECT label, round_even(quantile_cont(x, 0.1), 6) AS p10, round_even(quantile_cont(x, 0.5), 6) AS p50, round_even(quantile_cont(x, 0.9), 6) AS p90, round_even(quantile_cont(x, 0.9) - quantile_cont(x, 0.1), 6) AS spread FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label")
def level_percentiles(spark, d):
    x = table(spark, d, "embeddings").select("label", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    p = F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return x.groupBy("label").agg(p.alias("p")).select("label", *[F.bround(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], F.bround(F.col("p")[2] - F.col("p")[0], 6).alias("spread"))


@query("SELECT label, count(*) AS n, [round_even(v, 6) FOR v IN quantile_cont(x, [0.1, 0.2, 0.5, 0.9, 0.95, 0.99])] AS at FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label")
def bracketed_percentiles(spark, d):
    x = table(spark, d, "embeddings").select("label", F.explode("embedding").alias("x"))
    return percentiles.percentiles(x, "label", "x", [0.1, 0.2, 0.5, 0.9, 0.95, 0.99]).select("label", "n", F.transform("values", lambda v: F.bround(v, 6)).alias("at"))


@query("WITH s AS (SELECT vec_id, generate_subscripts(embedding, 1) AS spot, unnest(embedding)::DOUBLE AS x FROM embeddings), a AS (SELECT vec_id, spot, abs(x) < 0.1 AS f FROM s), b AS (SELECT vec_id, spot, spot - row_number() OVER (PARTITION BY vec_id ORDER BY spot) AS island FROM a WHERE f) SELECT vec_id, island, count(*) AS length, min(spot) AS first_at, max(spot) AS last_at FROM b GROUP BY ALL HAVING count(*) >= 4")
def quiet_islands(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at0", "x"))
    return ledger.islands(x.withColumn("f", F.abs(F.col("x").cast("double")) < 0.1), "vec_id", ["at0"], "f").filter("length >= 4")


@query("WITH s AS (SELECT vec_id, generate_subscripts(embedding, 1) AS spot, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, spot::INT - 1 AS place, round_even(sqrt(sum(x * x) OVER (PARTITION BY vec_id ORDER BY spot ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) / 8), 5) AS env FROM s")
def trailing_envelope(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "x")).withColumn("x", F.col("x").cast("double"))
    return signal.envelope(x, "vec_id", "at", "x", 8).select("vec_id", F.col("at").alias("place"), F.bround("env", 5).alias("env"))


@query("WITH s AS (SELECT vec_id, generate_subscripts(embedding, 1) AS spot, unnest(embedding)::DOUBLE AS x FROM embeddings), o AS (SELECT *, x > 0.22 * max(x) OVER (PARTITION BY vec_id) AS up FROM s), e AS (SELECT vec_id, up AND NOT coalesce(lag(up) OVER (PARTITION BY vec_id ORDER BY spot), false) AS edge FROM o) SELECT vec_id, count(*) FILTER (WHERE edge) AS edges FROM e GROUP BY vec_id")
def rising_edges(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "x")).withColumn("x", F.col("x").cast("double"))
    return signal.rising_edges(x, "vec_id", "at", "x")


@query("SELECT a.vec_id, round_even(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS shape FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_shape(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("u"))
    b = table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("v"))
    return a.join(b, "vec_id").select("vec_id", F.bround(signal.cosine(F.col("u"), F.col("v")), 6).alias("shape"))


@query()
def frame_spectrum(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.explode(signal.frames(F.col("embedding"), 32, 16)).alias("frame"))
    return rows.select("vec_id", F.array_max(signal.spectrum("frame")).alias("peak"), signal.periodicity("frame").alias("periodicity"))


@query("SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.page')) AS pages FROM events GROUP BY event_type")
def event_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.page")).alias("pages"))


# -- verdicts on clips; columns of lineitem and events stand in for measures ------------------------------------------


def _measures(spark, d):
    q, off = F.col("l_quantity"), F.col("l_discount")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (15 + q).alias("snr_db"), (-30 - q).alias("noise_db"), F.when(F.col("l_linenumber") != 4, off).alias("reverb"), (F.col("l_tax") / 2).alias("rumble"), (q / 5).alias("mud"),
        (off / 8).alias("presence"), (F.col("l_tax") * 30).alias("sibilance"), F.when(F.col("l_linenumber") != 2, q / 3).alias("wander_db"), off.alias("clip_pct"), (-10 - q / 2).alias("speech_db"),
    )


@query(O.CLIP_PLANS)
def clip_plans(spark, d):
    return quality.cleanup(_measures(spark, d)).drop("snr_db", "noise_db", "reverb", "rumble", "mud", "presence", "sibilance", "wander_db", "clip_pct", "speech_db")


@query(O.CLIP_CHANGES)
def clip_changes(spark, d):
    m = _measures(spark, d)
    return quality.changes(m, m.withColumn("l_linenumber", F.col("l_linenumber") - 1), ["l_orderkey", "l_linenumber"])


@query(O.CLIP_CHECKS)
def clip_checks(spark, d):
    v = F.col("value")
    c = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", 6000).otherwise(44100).alias("rate"), (F.col("event_id") % 3 + 1).cast("int").alias("channels"), ((v - 5) / 10).alias("seconds"), (v / 100).alias("peak"), (v / 5000).alias("rms"))
    found = quality.clip_problems(F.col("rate"), F.col("channels"), F.col("seconds"), F.col("peak"), F.col("rms"))
    return c.select("event_id", found.alias("problems"), quality.flag(F.col("peak"), F.col("rms") * 1000 - 40, F.col("seconds")).alias("flag"), quality.pitch_range(F.col("seconds") * 40).alias("pitch_range"))


@query(O.WHOLE_READINGS)
def whole_readings(spark, d):
    est = F.col("n_chars") / (F.col("doc_id") % 40 + 10).cast("double")
    return table(spark, d, "documents").select("doc_id", F.bround(quality.least_seconds(F.col("text")), 3).alias("need_s"), quality.complete(F.col("text"), est, est * 1.02).alias("complete"))


@query(O.GUARDED)
def guarded_values(spark, d):
    q = F.col("q")
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("q")).distinct().select("q", *N.guarded(q / 10 - 2, q / 5 - 5, q / 25), N.semitone_hz(q - 25).alias("hz"), N.clamp(q / 20, 0.5, 1.5).alias("speed"))


# -- speech front end ---------------------------------------------------------------------------------------------------


@query(O.ARC)
def arc_phases(spark, d):
    return speech.arc(table(spark, d, "documents"), "doc_id", "text", "documentary")


@query(O.MARKS)
def pause_marks(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.inline(speech.marks(F.col("text")))).withColumnRenamed("at", "spot")


@query(O.TOKENS)
def speech_tokens(spark, d):
    t = table(spark, d, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", speech.tokens(F.col("text")).alias("t"))
    return t.select("conv_id", "turn", F.size("t").alias("n"), F.md5(speech.join_tokens(F.col("t"))).alias("joined_md5"))


@query(O.NARRATOR_CHUNKS)
def narrator_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(speech.narrator_chunks(F.col("text"))).alias("pos", "chunk"))


@query(O.READING)
def reading_marks(spark, d):
    return reading.script(P.units(table(spark, d, "documents")), "doc_id", "pos", "text", 60).select("doc_id", "pos", "place", F.bround("running_s", 3).alias("running_s"), "mark")


@query(O.PASSAGES)
def merged_passages(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "value", (F.col("value") > 60).alias("f"))
    return ledger.merged_islands(rows, "user_id", ["ts", "event_id"], "f", 2, F.max("value").alias("peak"))


@query(O.HOSTS)
def host_dialogue(spark, d):
    rows = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    return dialogue.hosts(rows, "key").select("key.*", "pos", "s", "text")


from cantora.catalogs import expression as _expression  # noqa: E402, F401
from cantora.catalogs import front as _front  # noqa: E402, F401
from cantora.catalogs import jobs as _jobs  # noqa: E402, F401
from cantora.catalogs import small as _small  # noqa: E402, F401
from cantora.catalogs import sound as _sound  # noqa: E402, F401
from cantora.catalogs import words as _words  # noqa: E402, F401
