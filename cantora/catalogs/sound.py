"""Queries of clip analysis. The 64 numbers of an embedding stand in for samples, frame levels or spectra; they are not audio. What only makes sense on sound is tested on synthetic clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantora.operators import arc
from cantora.operators import audio as A
from cantora.registry import query, table

_X = "(SELECT vec_id, [x::DOUBLE for x in embedding] AS a FROM embeddings)"
_PLACES = "s AS (SELECT vec_id, generate_subscripts(embedding, 1)::INT - 1 AS place, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))


def _places(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode("a").alias("place", "x"))


_DB = lambda x: f"CASE WHEN {x} > 0 THEN round_even(20 * log10({x}), 1) ELSE -99.0 END::DOUBLE"


@query(f"WITH i AS (SELECT vec_id, [round_even(x * 120000, 0)::INT for x in a] AS a FROM {_X}), w AS (SELECT vec_id, a, [a[k:k + 7] for k in range(1, 65, 8)] AS w FROM i), r AS (SELECT vec_id, a, [sqrt(list_sum([v::DOUBLE * v for v in c]) / len(c)) / 32768.0::DOUBLE for c in w] AS r FROM w) SELECT vec_id, 0.16::DOUBLE AS seconds, {_DB('list_max([abs(v) for v in a]) / 32768.0::DOUBLE')} AS peak_db, {_DB('sqrt(list_sum([v::DOUBLE * v for v in a]) / 64) / 32768.0::DOUBLE')} AS rms_db, round_even(100.0::DOUBLE * 8 * len([v for v in r if v < 0.0032]) / 64, 1) AS silence_pct, round_even(100.0::DOUBLE * len([v for v in a if abs(v) >= 32700]) / 64, 3) AS clipped_pct, {_DB('list_sort(r)[1]')} AS floor_db FROM r")
def clip_stats(spark, d):
    rows = _vectors(spark, d).select("vec_id", F.transform("a", lambda x: F.rint(x * 120000).cast("int")).alias("x"))
    return rows.select("vec_id", A.wav_stats(F.col("x"), F.lit(400)).alias("s")).select("vec_id", "s.*")


@query("SELECT vec_id, (k - 1)::INT AS chunk, ((k - 1) * 20)::INT AS pos, least(20, 64 - (k - 1) * 20)::INT AS take, ((k - 1) * 20 - greatest(0, (k - 1) * 20 - 3))::INT AS lead, (least(64, k * 20 + 3) - greatest(0, (k - 1) * 20 - 3))::INT AS held FROM embeddings, range(1, 5) r(k)")
def context_chunks(spark, d):
    return A.chunk_ranges(_vectors(spark, d), "vec_id", "a", F.lit(20), F.lit(3)).select("vec_id", "chunk", "pos", "take", "lead", F.size("part").alias("held"))


@query(f"SELECT vec_id, round_even(list_sum([x * i for x, i in a]), 6) AS turned FROM {_X}")
def rejoined_chunks(spark, d):
    got = A.rejoined(A.chunk_ranges(_vectors(spark, d), "vec_id", "a", F.lit(20), F.lit(3)), "vec_id")
    return got.select("vec_id", F.bround(F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6).alias("turned"))


@query(f"WITH {_PLACES}, p AS (SELECT vec_id, quantile_cont(x * 40, 0.2) AS lo, quantile_cont(x * 40, 0.9) AS hi FROM s GROUP BY 1), m AS (SELECT vec_id, avg(x * 40) FILTER (x * 40 <= lo) AS n, avg(x * 40) FILTER (x * 40 >= hi - 10) AS v FROM s JOIN p USING (vec_id) GROUP BY 1) SELECT vec_id, round_even(n, 5) AS noise_db, round_even(v, 5) AS speech_db, round_even(least(120, v - greatest(n, -120)), 5) AS snr_db FROM m")
def noise_and_speech(spark, d):
    got = A.noise_split(_places(spark, d).withColumn("db", F.col("x") * 40), "vec_id", "db")
    return got.select("vec_id", *[F.bround(c, 5).alias(c) for c in ("noise_db", "speech_db", "snr_db")])


@query(f"WITH {_PLACES}, a AS (SELECT *, place - row_number() OVER (PARTITION BY vec_id ORDER BY place) AS run FROM s WHERE x > -0.05), r AS (SELECT vec_id, run, avg(x) AS m FROM a GROUP BY ALL HAVING count(*) >= 2) SELECT vec_id, count(*) AS phrases, round_even(CASE WHEN count(*) >= 6 THEN quantile_cont(m, 0.9) - quantile_cont(m, 0.1) END, 6) AS dyn_db FROM r GROUP BY 1")
def phrase_levels(spark, d):
    return A.phrase_spread(_places(spark, d), "vec_id", "place", "x", F.lit(-0.05), 2).select("vec_id", "phrases", F.bround("dyn_db", 6).alias("dyn_db"))


_RDB = "f AS (SELECT vec_id, place, CASE WHEN place // 8 % 2 = 0 THEN -20 + x ELSE -65 + 60 * x END AS rdb FROM s)"


@query(f"WITH {_PLACES}, {_RDB}, t AS (SELECT *, quantile_cont(rdb, 0.95) OVER (PARTITION BY vec_id) AS top FROM f), q AS (SELECT *, place - row_number() OVER (PARTITION BY vec_id ORDER BY place) AS run FROM t WHERE rdb < top - 30), n AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY vec_id, run ORDER BY place) - 1 AS i FROM q WINDOW w AS (PARTITION BY vec_id, run)), g AS (SELECT vec_id, run, min(place) AS a, any_value(n) AS n, max(rdb) FILTER (i >= greatest(1, floor(n * 0.3)) AND i < greatest(greatest(1, floor(n * 0.3)) + 1, n - greatest(1, floor(n * 0.3)))) AS pk FROM n WHERE n * 0.1 >= 0.4 GROUP BY ALL) SELECT vec_id, round_even(a * 0.1::DOUBLE, 2) AS start_s, round_even(n * 0.1::DOUBLE, 2) AS seconds, round_even(pk, 1) AS peak_db FROM g WHERE pk > -70")
def sounds_in_pauses(spark, d):
    rows = _places(spark, d).withColumn("rdb", F.when(F.floor(F.col("place") / 8) % 2 == 0, -20 + F.col("x")).otherwise(-65 + 60 * F.col("x")))
    return A.pause_sounds(rows, "vec_id", "place", 0.1)


_AIRY = "f AS (SELECT vec_id, place, 60 + 20 * x AS level, 40 * x AS air, abs(x) AS per FROM s)"
_SCALE = "p AS (SELECT vec_id, quantile_cont(level, 0.1) AS p10, quantile_cont(level, 0.95) AS p95 FROM f GROUP BY 1), o AS (SELECT f.vec_id, any_value(p10) AS p10, median(air) AS air0, median(level) AS level0 FROM f JOIN p USING (vec_id) WHERE level >= p95 - 25 GROUP BY 1)"


@query(f"WITH {_PLACES}, {_AIRY}, {_SCALE}, h AS (SELECT f.*, air0, air - air0 > 6 AND per < 0.3 AND level > greatest(p10 + 12 - 11, level0 - 30) AS fl FROM f JOIN o USING (vec_id)), n AS (SELECT vec_id, place, coalesce(place - lag(place) OVER (PARTITION BY vec_id ORDER BY place) - 1 > 2, true)::INT AS new FROM h WHERE fl), r AS (SELECT vec_id, place, sum(new) OVER (PARTITION BY vec_id ORDER BY place) AS run FROM n), e AS (SELECT vec_id, run, min(place) AS a, max(place) AS b FROM r GROUP BY ALL), m AS (SELECT e.vec_id, a, b, avg(air - air0) AS air, avg(per) AS per FROM e JOIN h ON h.vec_id = e.vec_id AND place BETWEEN a AND b GROUP BY ALL), z AS (SELECT *, (b - a + 1) * 0.15::DOUBLE AS secs, (b - a + 1) * 0.15::DOUBLE >= 0.8 AND per <= 0.28 AS whole FROM m) SELECT vec_id, round_even(a * 0.15::DOUBLE, 2) AS start_s, round_even(secs, 2) AS seconds, round_even(air, 1) AS air, round_even(per, 2) AS per, whole FROM z WHERE whole OR secs >= 0.25")
def airy_runs(spark, d):
    rows = _places(spark, d).select("vec_id", "place", (60 + 20 * F.col("x")).alias("level"), (40 * F.col("x")).alias("air"), F.abs("x").alias("per"))
    return A.airy_passages(rows, "vec_id", "place", 0.15, above_floor=1.0)


@query(f"WITH {_PLACES}, {_AIRY}, p AS (SELECT vec_id, quantile_cont(level, 0.95) AS p95 FROM f GROUP BY 1), m AS (SELECT vec_id, median(air) AS air, median(per) AS per FROM f JOIN p USING (vec_id) WHERE level >= p95 - 25 GROUP BY 1) SELECT vec_id, round_even(air, 6) AS air, round_even(per, 6) AS per, per < 0.4 AND air > -12 AS whispered FROM m")
def airy_verdicts(spark, d):
    rows = _places(spark, d).select("vec_id", "place", (60 + 20 * F.col("x")).alias("level"), (40 * F.col("x")).alias("air"), F.abs("x").alias("per"))
    return A.airy_files(rows, "vec_id").select("vec_id", F.bround("air", 6).alias("air"), F.bround("per", 6).alias("per"), "whispered")


@query(f"SELECT vec_id, round_even(list_sum([list_sum([a[greatest(1, i - j)] for j in range(0, 5)]) / 5 * i for i in range(1, 65)]), 5) AS held, round_even(list_sum([list_sum([coalesce(a[CASE WHEN i - 2 + j BETWEEN 1 AND 64 THEN i - 2 + j END], 0) for j in range(0, 4)]) / 4 * i for i in range(1, 65)]), 5) AS centred FROM {_X}")
def smoothed(spark, d):
    turned = lambda a: F.bround(F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 5)
    return _vectors(spark, d).select("vec_id", turned(A.held_mean(F.col("a"), 5)).alias("held"), turned(A.centred_mean(F.col("a"), 4)).alias("centred"))


@query("WITH x AS (SELECT a.vec_id, [v::DOUBLE * 60 for v in a.embedding] AS a, [v::DOUBLE * 60 for v in b.embedding] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), c AS (SELECT vec_id, a, b, [v - list_avg(a) for v in a] AS p, [v - list_avg(b) for v in b] AS q, [abs(a[i] - b[i]) for i in range(1, 65)] AS d FROM x) SELECT vec_id, round_even(list_dot_product(p, q) / sqrt(list_dot_product(p, p) * list_dot_product(q, q)), 6) AS corr, round_even(list_max(d), 6) AS worst, round_even(sqrt(list_sum([v * v for v in d]) / 64), 6) AS rms, len([1 for i in range(1, 65) if greatest(a[i], b[i]) < -50])::INT AS empty FROM c")
def moved_bands(spark, d):
    a = _vectors(spark, d).select("vec_id", F.transform("a", lambda x: x * 60).alias("a"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    rows = a.join(b, "vec_id").select("vec_id", A.correlation(F.col("a"), F.col("b")).alias("corr"), A.bands_moved(F.col("a"), F.col("b")).alias("m"))
    return rows.select("vec_id", F.bround("corr", 6).alias("corr"), F.bround("m.worst", 6).alias("worst"), F.bround("m.rms", 6).alias("rms"), F.col("m.empty").alias("empty"))


@query(f"SELECT vec_id, round_even(list_avg([a[i + 1] * a[i + 1] for i in range(0, 64) if i * 16000 / 126.0 >= 150 AND i * 16000 / 126.0 < 350]) / list_avg([a[i + 1] * a[i + 1] for i in range(0, 64) if i * 16000 / 126.0 >= 350 AND i * 16000 / 126.0 < 1500]), 6) AS mud, round_even(list_avg([a[i + 1] * a[i + 1] for i in range(0, 64) if i * 16000 / 126.0 >= 5000 AND i * 16000 / 126.0 < 9000]) / list_avg([a[i + 1] * a[i + 1] for i in range(0, 64) if i * 16000 / 126.0 >= 2000 AND i * 16000 / 126.0 < 5000]), 6) AS sib FROM {_X}")
def band_ratios(spark, d):
    p = F.transform("a", lambda x: x * x)
    band = lambda lo, hi: A.band_power(p, F.lit(16000.0), lo, hi)
    return _vectors(spark, d).select("vec_id", F.bround(band(150, 350) / band(350, 1500), 6).alias("mud"), F.bround(band(5000, 9000) / band(2000, 5000), 6).alias("sib"))


@query(f"SELECT vec_id, round_even(list_sum([CASE WHEN i % 64 < 8 AND i >= 64 THEN a[i % 64 + 1] * (i % 64) / 7.0::DOUBLE + a[64 - 8 + i % 64 + 1] * (1 - (i % 64) / 7.0::DOUBLE) ELSE a[i % 64 + 1] END * CASE WHEN i < 10 THEN i / 9.0::DOUBLE ELSE 1 END * CASE WHEN i >= 130 THEN 1 - (i - 130) / 19.0::DOUBLE ELSE 1 END * (i + 1) for i in range(0, 150)]), 4) AS turned FROM {_X}")
def looped_beds(spark, d):
    bed = A.looped(F.col("a"), F.lit(150), 8, 10, 20)
    return _vectors(spark, d).select("vec_id", F.bround(F.aggregate(F.transform(bed, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4).alias("turned"))


@query("WITH l AS (SELECT vec_id // 4 AS batch, vec_id % 4 AS pos, (20 + vec_id % 4 * 10)::INT AS n, vec_id, embedding FROM embeddings), s AS (SELECT *, sum(n + 5) OVER (PARTITION BY batch ORDER BY pos) - n - 5 AS start FROM l) SELECT batch, pos, start::INT AS start, n AS size, round_even(list_sum([v::DOUBLE for v in embedding[1:n]]), 6) AS total FROM s")
def welded_lines(spark, d):
    v = F.col("vec_id")
    lines = _vectors(spark, d).select(F.floor(v / 4).alias("batch"), (v % 4).alias("pos"), F.slice("a", F.lit(1), (20 + v % 4 * 10).cast("int")).alias("x"))
    welded = A.weld(lines, "batch", "pos", "x", 5)
    cut = A.unweld(welded.withColumn("out", F.col("joined")), "batch", "out")
    where = welded.select("batch", F.explode(F.arrays_zip("pos", "starts")).alias("w")).select("batch", F.col("w.pos").alias("pos"), F.col("w.starts").alias("start"))
    return cut.join(where, ["batch", "pos"]).select("batch", "pos", "start", F.size("x").alias("size"), F.bround(F.aggregate("x", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_HOP, _WIN, _SMOOTH = 0.02, 12, 4
_ARC_SQL = f"""
    WITH {_PLACES},
    q(style, swell, beat_db, ease, presence, presence_floor, ease_s, step, least_words) AS (VALUES ('cinematic', 1.35::DOUBLE, 0.45::DOUBLE, -2.30::DOUBLE, 1.50::DOUBLE, 0.35::DOUBLE, 0.42::DOUBLE, 0.35::DOUBLE, 5), ('bedtime', 0.45, 0.10, -2.15, 0.0, 0.0, 0.60, 0.15, 4)),
    r AS (SELECT vec_id, k::INT AS sentence, k * 21 + vec_id % 3 AS lo, k * 21 + 18 + vec_id % 5 AS hi, ['cinematic', 'bedtime', 'novel'][(vec_id + k) % 3 + 1] AS style, 2 + (vec_id + k) % 6 AS words FROM embeddings, range(3) AS u(k)),
    f AS (SELECT s.vec_id, place, abs(x) AS e, place - lo AS j, sentence, style, words, q.* EXCLUDE (style) FROM s JOIN r ON r.vec_id = s.vec_id AND place >= lo AND place < hi LEFT JOIN q USING (style)),
    g AS (SELECT *, max(e) OVER w AS top, count(*) OVER w AS n, avg(e) OVER (PARTITION BY vec_id, sentence ORDER BY place ROWS BETWEEN CURRENT ROW AND {_WIN - 1} FOLLOWING) AS m FROM f WINDOW w AS (PARTITION BY vec_id, sentence)),
    h AS (SELECT *, min(j) FILTER (e > 0.08 * top) OVER w AS a, max(j) FILTER (e > 0.08 * top) OVER w AS b, count(*) FILTER (e > 0.08 * top) OVER w AS v FROM g WINDOW w AS (PARTITION BY vec_id, sentence)),
    i AS (SELECT *, swell IS NOT NULL AND n >= 3 AND v >= 3 AS live, max(m) FILTER (swell IS NOT NULL AND n >= 3 AND v >= 3 AND j >= a AND j < greatest(a + 1, b - {_WIN})) OVER (PARTITION BY vec_id, sentence) AS best FROM h),
    k AS (SELECT *, min(j) FILTER (live AND j >= a AND j < greatest(a + 1, b - {_WIN}) AND m = best) OVER (PARTITION BY vec_id, sentence) AS beat, swell * CASE WHEN words >= least_words THEN 1 ELSE 0.4::DOUBLE END AS sw, beat_db * CASE WHEN words >= least_words THEN 1 ELSE 0.5::DOUBLE END AS li,
        ease * CASE WHEN words >= least_words THEN 1 ELSE 0.5::DOUBLE END AS ea, greatest(1, floor(ease_s / {_HOP}::DOUBLE)) AS tail FROM i),
    l AS (SELECT *, CASE WHEN j >= b THEN ea WHEN j >= beat THEN li + CASE WHEN b - beat > 1 THEN (ea - li) * (j - beat) / (b - beat - 1) ELSE 0 END WHEN j >= a THEN -sw + CASE WHEN beat - a > 1 THEN (li + sw) * (j - a) / (beat - a - 1) ELSE 0 END ELSE 0 END AS c FROM k),
    o AS (SELECT *, CASE WHEN live THEN CASE WHEN b > tail AND ea < -0.2 AND j >= b - tail AND j < b THEN least(c, CASE WHEN tail > 1 THEN ea * 0.85::DOUBLE * (j - b + tail) / (tail - 1) ELSE 0 END) ELSE c END + CASE WHEN sentence % 2 = 1 THEN step ELSE -0.6::DOUBLE * step END ELSE 0 END AS arc FROM l)
    SELECT vec_id, place, sentence, style, beat,
        round_even(CASE WHEN n > {_SMOOTH} THEN sum(arc) OVER (PARTITION BY vec_id, sentence ORDER BY place ROWS BETWEEN {_SMOOTH // 2} PRECEDING AND {_SMOOTH - 1 - _SMOOTH // 2} FOLLOWING) / {_SMOOTH} ELSE arc END, 6) + 0.0 AS arc_db,
        round_even(sum(arc) OVER (PARTITION BY vec_id ORDER BY place RANGE BETWEEN {_SMOOTH // 2} PRECEDING AND {_SMOOTH - 1 - _SMOOTH // 2} FOLLOWING) / {_SMOOTH}, 6) + 0.0 AS gain_db,
        round_even(CASE WHEN live THEN presence_floor + presence * exp(-pow((j + 0.5::DOUBLE - beat) * {_HOP}::DOUBLE / 0.28::DOUBLE, 2)) ELSE 0 END, 6) AS presence_db
    FROM o
"""


@query(_ARC_SQL)
def sentence_gain_arcs(spark, d):
    v = F.col("vec_id")
    of = table(spark, d, "embeddings").select("vec_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("sentence"))
    k = F.col("sentence")
    said = of.select("vec_id", "sentence", (k * 21 + v % 3).alias("lo"), (k * 21 + 18 + v % 5).alias("hi"), F.get(F.array(*map(F.lit, ("cinematic", "bedtime", "novel"))), ((v + k) % 3).cast("int")).alias("style"), (2 + (v + k) % 6).alias("words"))
    got = arc.gain_arcs(_places(spark, d).withColumn("level", F.abs("x")), said, arc.styles(spark), "vec_id", "place", "level", _HOP)
    return got.select("vec_id", "place", "sentence", "style", "beat", *(F.bround(c, 6).alias(c) for c in ("arc_db", "gain_db", "presence_db")))
