"""Queries of the smaller operators: dialogues by paragraph, budgets, reasons, second passes, settings, the style list."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantora import oracle as O
from cantora.functions import fixed as X
from cantora.functions import frontend
from cantora.functions import segment as S
from cantora.operators import curate, quality
from cantora.plans import dialogue, reading
from cantora.plans import performance as P
from cantora.registry import query, table

_LIT = lambda x: "'" + x.replace("'", "''") + "'"
_TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_SAY = X.PARAGRAPH_HOSTS["km"]
_TOPIC = "CASE WHEN length(line) <= 70 THEN line WHEN strpos(line[:70], ' ') = 0 THEN line[:70] ELSE array_to_string(string_split(line[:70], ' ')[:-2], ' ') END"


@query(rf"""
WITH d AS (SELECT doc_id, [p for p in [{_TRIM('x')} for x in string_split({_TRIM('text')}, chr(10))] if p <> ''] AS p, {_TRIM(f"split_part({_TRIM('text')}, chr(10), 1)")} AS line FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE [''] END AS p, {_TOPIC} AS topic FROM d),
b AS (SELECT doc_id, topic, p, flatten([CASE WHEN i = 1 THEN [{{'s': 'A', 'text': p[1]}}] ELSE [{{'s': CASE WHEN i % 2 = 1 THEN 'B' ELSE 'A' END, 'text': CASE WHEN i % 2 = 1 THEN ({_SAY['B']})[(i - 2) // 2 % 6 + 1] ELSE ({_SAY['A']})[(i - 2) // 2 % 6 + 1] END}}, {{'s': CASE WHEN i % 2 = 1 THEN 'A' ELSE 'B' END, 'text': p[i]}}] END for i in range(1, len(p) + 1)]) AS l FROM e),
a AS (SELECT doc_id, list_concat([{{'s': 'A', 'text': {_LIT(_SAY['open'][0][:-2])} || topic}}, {{'s': 'B', 'text': {_LIT(_SAY['open'][1])}}}], list_concat(l, [{{'s': 'A', 'text': {_LIT(_SAY['close'][0])}}}, {{'s': 'B', 'text': {_LIT(_SAY['close'][1])}}}])) AS l FROM b)
SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS pos, unnest([x.s for x in l]) AS s, unnest([x.text for x in l]) AS text FROM a
""")
def paragraph_dialogue(spark, d):
    return dialogue.paragraph_hosts(table(spark, d, "documents").filter("text IS NOT NULL"), "doc_id", "km")


@query(O.UNITS.replace(".!?…។", ".!?…เ។") + r""", f AS (SELECT *, regexp_matches(text, '[\p{L}\p{N}]') AS loud FROM units), g AS (SELECT *, sum(loud::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM f) SELECT doc_id, (grp - 1)::INT AS pos, array_to_string(list(text ORDER BY pos), ' ') AS text, coalesce(arg_max(boundary, pos) FILTER (loud OR boundary <> 'para'), 'para') AS boundary FROM g WHERE grp > 0 GROUP BY doc_id, grp""")
def studio_units(spark, d):
    # by doc_id: a file has few row groups
    return table(spark, d, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(S.studio_units(F.col("text"))).alias("pos", "u")).select("doc_id", "pos", "u.text", "u.boundary")


@query(O.UNITS + ", b AS (SELECT doc_id, pos, sum(round_even(length(text) / 13.5::DOUBLE * 1000, 0)) OVER (PARTITION BY doc_id ORDER BY pos) AS ms FROM units) SELECT doc_id, pos FROM b WHERE ms <= 26000 OR pos = 0")
def budgeted_units(spark, d):
    return reading.within(P.units(table(spark, d, "documents")), "doc_id", "pos", F.length("text") / 13.5).select("doc_id", "pos")


_M = O._MEASURES


@query(f"WITH m AS ({_M}) SELECT l_orderkey, l_linenumber, [x for x in [CASE WHEN snr_db < 42 THEN printf('noise floor %.0f dB, SNR %.0f dB', noise_db, snr_db) END, CASE WHEN reverb > 0.02::DOUBLE THEN printf('ringing after the words (%.3f of speech energy)', reverb) WHEN reverb IS NULL THEN 'reverb not measurable (no quiet gaps)' END, CASE WHEN rumble > 0.02::DOUBLE THEN printf('low rumble %.3f', rumble) END, CASE WHEN mud > 7 THEN printf('low-mid weight high (%.2f)', mud) END, CASE WHEN presence < 0.008::DOUBLE THEN printf('clarity low (%.4f)', presence) END, CASE WHEN wander_db > 10 THEN printf('phrase level wanders %.1f dB (healthy voices ≤ 9.3)', wander_db) END] if x IS NOT NULL] AS reasons FROM (SELECT * REPLACE (round(rumble, 2) AS rumble, round(presence, 3) AS presence, round(wander_db, 0) AS wander_db) FROM m)")
def cleanup_reasons(spark, d):
    from cantora.catalog import _measures

    rows = _measures(spark, d).withColumns({"rumble": F.round("rumble", 2), "presence": F.round("presence", 3), "wander_db": F.round("wander_db", 0), "sibilance": F.lit(0.0)})
    return rows.select("l_orderkey", "l_linenumber", quality.reasons().alias("reasons"))


@query()
def second_passes(spark, d):
    from cantora.catalog import _measures

    m, key = _measures(spark, d), ["l_orderkey", "l_linenumber"]
    first = quality.changes(m, m.withColumn("l_linenumber", F.col("l_linenumber") - 1), key)
    return quality.second_pass(m, first, key).select(*key, "strength", "redone")


@query("SELECT event_id, greatest(-12.0, least(12.0, event_id % 40 - 20.0))::DOUBLE AS pitch, 0.75::DOUBLE AS indexRate, CASE WHEN event_type = 'click' THEN 'pm' ELSE 'rmvpe' END AS f0Method, 'khmer' AS scope, 'm' || event_id AS model FROM events")
def clone_settings(spark, d):
    e = F.col("event_id")
    given = F.create_map(F.lit("pitch"), (e % 40 - 20).cast("string"), F.lit("indexRate"), F.lit("high"), F.lit("f0Method"), F.when(F.col("event_type") == "click", "pm").otherwise("other"), F.lit("model"), F.concat(F.lit(" m"), e.cast("string")))
    s = curate.merged_settings(given, X.CLONE_SETTINGS, X.CLONE_LIMITS, X.CLONE_CHOICES)
    return table(spark, d, "events").select("event_id", s.alias("s")).select("event_id", "s.pitch", "s.indexRate", "s.f0Method", "s.scope", "s.model")


@query("SELECT * FROM (VALUES " + ", ".join(f"({_LIT(r[0])}, {r[1]}, {r[2]}, {_LIT(X.STYLE_PITCH[r[0]][6])})" for r in X.STYLES) + ") v(style, lo, hi, label)")
def style_lines(spark, d):
    return P.style_table(spark).select("style", "lo", "hi", "label")


@query("SELECT conv_id, turn, length(text)::INT AS n FROM conversations")
def prepared_once(spark, d):
    """Each distinct text is prepared once; its length tells it apart from the others' here."""
    made = curate.once_each(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", lambda t: F.struct(frontend.safe(t).alias("safe"), F.length(t).alias("n")))
    return made.select("conv_id", "turn", F.col("made.n").alias("n"))
