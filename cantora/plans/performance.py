"""The performance plan: each sentence's emotion, intensity, pace, gain and pauses in each style."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cantora.functions import fixed as X
from cantora.functions.greedy import let
from cantora.functions.segment import plan_units
from cantora.functions.text import word_count

CHANNELS = list(X.CUES)


#: What a plan needs of its style after the ordered passes only.
_AFTER = [c for c in X.STYLE_FIELDS if c not in ("style", "lo", "hi", "base", "contrast")] + ["micro", "deliveries", "pause_times", "emphases"]


def styles(spark: SparkSession) -> DataFrame:
    """The style dimension: 13 rows with the channels' weights, and each delivery's pause factor and emphasis."""
    slots = lambda name, k: [X.MOVES[n][k] for n, _ in X.DELIVERIES[name]]
    rows = [(k, *row, *X.WEIGHTS[row[0]], X.FEELING_SLOT[row[0]], {c: at[row[0]] for c, at in X.SPECIAL_SLOT.items()}, X.STYLE_PITCH[row[0]][3], [n for n, _ in X.DELIVERIES[row[0]]], pause_times(row[0]), slots(row[0], 0)) for k, row in enumerate(X.STYLES)]
    return spark.createDataFrame(rows, ["style_no", *X.STYLE_FIELDS, *(f"w_{c}" for c in CHANNELS), "feeling_slots", "special_slots", "micro", "deliveries", "pause_times", "emphases"])


#: Cue words by group, in order; a group's words get consecutive numbers.
_SPECIAL = {c: [w for p in pattern.replace("(?:her|his|my)", "*").split("|") for w in ([p.replace("*", own) for own in ("her", "his", "my")] if "*" in p else [p])] for c, pattern in X.SPECIAL_CUES.items()}
GROUPS = {**{f"cue_{c}": ws for c, ws in X.CUES.items()}, **{f"feel_{c}": ws for c, ws in X.FEELING_CUES.items()}, **{f"special_{c}": ws for c, ws in _SPECIAL.items()}, "suspend": X.SUSPEND_CUES, **{f"own_{s}": ws for s, ws in X.OWN_STRESS.items()}}
_SPANS, _IDS = {}, {}
for _g, _ws in GROUPS.items():
    _from = sum(b - a for a, b in _SPANS.values())
    _SPANS[_g] = (_from, _from + len(_ws))
    for _k, _w in enumerate(_ws):
        _IDS.setdefault(_w.lower(), []).append(_from + _k)


def _trie(words) -> str:
    """A pattern that matches the longest of the words at a place, sharing their beginnings."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(h) + _trie(rest) for h, rest in heads.items()]
    body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return (f"(?:{body})?" if "" in words else body) if parts else ""


def cues(text: Column) -> Column:
    """The numbers of all cue words that a text holds, found in one pass: at each place the longest word, and with it all words that begin it."""
    held = {w: [i for v, ids in _IDS.items() if w.startswith(v) for i in ids] for w in _IDS}
    table = F.create_map(*[x for w, ids in held.items() for x in (F.lit(w), F.array(*map(F.lit, ids)))])
    # nearly every place of a text is none of a cue's beginnings: one test leaves out all Khmer ones
    khmer = [w for w in _IDS if "ក" <= w[0] <= "៿"]
    found = F.regexp_extract_all(F.lower(text), F.lit(f"(?=({_trie([w for w in _IDS if w not in khmer])}|(?=[ក-៿]){_trie(khmer)}))"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(found), lambda w: F.element_at(table, w))))


def _of(hits: Column, group: str) -> Column:
    a, b = _SPANS[group]
    return F.filter(hits, lambda i: (i >= a) & (i < b))


def _any(hits: Column, *groups: str) -> Column:
    spans = [_SPANS[g] for g in groups]
    return F.exists(hits, lambda i: reduce(or_, [(i >= a) & (i < b) for a, b in spans]))


def units(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, carry's columns, pos, text, boundary, last. Texts are dealt by doc_id first: a file has few row groups, cutting costs far more than moving a text, and windows over a text then need no more shuffles."""
    return docs.select("doc_id", *carry, "text").repartition("doc_id").select("doc_id", *carry, F.posexplode(let(plan_units(F.col("text")), lambda us: F.transform(us, lambda u, i: F.struct(u["text"].alias("text"), u["boundary"].alias("boundary"), (i == F.size(us) - 1).alias("last"))))).alias("pos", "u")).select("doc_id", *carry, "pos", "u.*")


def feelings(hits: Column) -> Column:
    """The feelings among the cues found, in fixed order."""
    return F.array_compact(F.array(*[F.when(_any(hits, f"feel_{c}"), c) for c in X.FEELING_CUES]))


def auto_emotion(found, style: str):
    """The emotion to perform: of the feelings found, the first whose slot in the style is nearest to 1."""
    if_known = F.create_map(*[F.lit(x) for kv in X.FEELING_SLOT[style].items() for x in kv])
    ranked = F.transform(found, lambda c, i: F.struct(F.abs(F.coalesce(F.try_element_at(if_known, c), F.lit(1)) - 1).alias("far"), i.alias("i"), c.alias("c")))
    named = F.create_map(*[F.lit(x) for kv in X.FEELING_EMOTION.items() for x in kv])
    return F.coalesce(F.try_element_at(named, F.array_min(ranked)["c"]), F.lit("neutral"))


def analyse(sentences: DataFrame, spark: SparkSession, only: list[str] | None = None) -> DataFrame:
    """Each sentence in each style with its emotion and intensity before the ordered passes. A text is searched once, before the styles' join, and does not go through it: what later passes need are its numbers."""
    dim = styles(spark)
    dim = dim.filter(F.col("style").isin(only)) if only else dim
    speaker = F.col("speaker") if "speaker" in sentences.columns else F.lit(None).cast("string")
    hits = F.col("_hits")
    special = F.coalesce(*[F.when(_any(hits, f"special_{c}"), c) for c in X.SPECIAL_CUES])
    base = sentences.withColumn("_hits", cues(F.col("text"))).select(
        "doc_id", "pos", "boundary", speaker.alias("speaker"), F.length("text").alias("chars"), *[F.least(F.lit(3), F.size(_of(hits, f"cue_{c}"))).alias(f"n_{c}") for c in CHANNELS], word_count(F.col("text")).alias("words"),
        F.col("text").rlike("[\"“”«»‘’']").alias("is_dialogue"), F.col("text").rlike("[0-9]").alias("digits"), special.alias("special"), F.get(feelings(hits), 0).alias("feeling"), "last",
        _any(hits, "suspend").alias("open_words"), _any(hits, *(f"cue_{c}" for c in CHANNELS)).alias("cued"), *[_any(hits, f"own_{s}").alias(f"own_{s}") for s in X.OWN_STRESS],
    )
    both = base.crossJoin(F.broadcast(dim))  # 13 styles at most
    lifts = [F.col(f"w_{c}") * F.col(f"n_{c}") for c in CHANNELS]
    score = sum((x * 0.7 for x in lifts), F.lit(0.0))
    score = score + F.when(F.col("boundary") == "!", 10).when(F.col("boundary") == "?", 6).when(F.col("boundary") == "…", 4).otherwise(0)
    score = score + F.when(F.col("style").isin("trailer", "thriller", "cinematic", "storytelling") & (F.col("words") <= 7), 7).otherwise(0)
    score = score + F.when(F.col("style").isin("documentary", "news") & F.col("digits"), 8).otherwise(0) + F.when(F.col("last"), 4).otherwise(0)
    best = F.greatest(*lifts)
    emotion = F.lit(X.EMOTION["none"])
    for c, x in reversed(list(zip(CHANNELS, lifts, strict=True))):  # the earlier channel wins a tie
        emotion = F.when((best > 0) & (x == best), X.EMOTION[c]).otherwise(emotion)
    intensity = F.bround(F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("base") + score)), 0).cast("int")
    calm = F.when(emotion == "neutral", F.try_element_at("feeling_slots", F.lit("peace")))
    slot = F.coalesce(F.try_element_at("special_slots", F.col("special")), F.try_element_at("feeling_slots", F.col("feeling")), calm).cast("int")
    stressed = F.col("cued") | reduce(or_, [(F.col("style") == s) & F.col(f"own_{s}") for s in X.OWN_STRESS])
    return both.select("doc_id", "style", "pos", "boundary", "speaker", "chars", "words", "is_dialogue", "last", "open_words", stressed.alias("stressed"), emotion.alias("emotion"), intensity.alias("intensity"), slot.alias("slot"), *X.STYLE_FIELDS[1:], "micro", "deliveries", "pause_times", "emphases")


def contrast(rows: DataFrame) -> DataFrame:
    """Spreads a flat curve of three sentences or more, then holds a quarter of them (the quietest) at the quiet line."""
    w, k = W.partitionBy("doc_id", "style"), F.col("intensity")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("mean", F.sum("intensity").over(w) / F.col("n")).withColumn("spread", F.max("intensity").over(w) - F.min("intensity").over(w)).withColumn("want", (F.col("hi") - F.col("lo")) * F.col("contrast") * 0.55)
    wide = F.bround(F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("mean") + (k - F.col("mean")) * (F.col("want") / F.nullif(F.col("spread"), F.lit(0))))), 0).cast("int")
    rows = rows.withColumn("intensity", F.when((F.col("n") >= 3) & (F.col("spread") > 0) & (F.col("spread") < F.col("want")), wide).otherwise(k))
    rows = rows.withColumn("line", F.col("lo") + (F.col("hi") - F.col("lo")) * 0.3).withColumn("quiet", F.sum((k <= F.col("line")).cast("int")).over(w)).withColumn("need", F.greatest(F.lit(1), F.bround(F.col("n") * 0.25, 0).cast("int"))).withColumn("r", F.row_number().over(w.orderBy("intensity", "pos")))
    held = (F.col("n") >= 3) & (F.col("quiet") < F.col("need")) & (F.col("r") <= F.col("need"))
    return rows.withColumn("intensity", F.when(held, F.bround(F.least(k, F.col("line")), 0).cast("int")).otherwise(k)).drop("mean", "spread", "want", "line", "quiet", "need", "r")


def arc(rows: DataFrame) -> DataFrame:
    """The emotional curve of the two styles that have one: peak, lift, calm ends."""
    peak = F.when(F.col("style") == "sad_romantic", 0.62).when(F.col("style") == "cinematic", 0.68)
    lift, calm = F.when(F.col("style") == "sad_romantic", 15.0).otherwise(18.0), F.when(F.col("style") == "sad_romantic", 0.72).otherwise(0.66)
    x = F.col("pos") / (F.col("n") - 1).cast("double")
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.abs(x - peak) / F.greatest(peak, 1.0 - peak)))
    delta = (v - 0.5) * 2.0 * lift - F.when((F.col("pos") == 0) | F.col("last"), lift * (1.0 - calm)).otherwise(0.0)
    return rows.withColumn("intensity", F.when(peak.isNotNull() & (F.col("n") >= 3), F.bround(F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("intensity") + delta)), 0).cast("int")).otherwise(F.col("intensity")))


def _rounded(x, places: int):
    """Half to even, on the scaled number."""
    return F.rint(x * 10.0**places) / 10.0**places


def speaker_shift(speaker: Column) -> Column:
    """-1, 0 or 1 for a speaker's name (by its code points), 0 without one: how far the voice is moved to tell speakers apart."""
    points = F.aggregate(F.filter(F.split(speaker, ""), lambda x: x != ""), F.lit(0), lambda a, x: a + F.ascii(x))
    return F.when(speaker.isNull() | (speaker == ""), 0).otherwise(points % 3 - 1)


def plan(docs: DataFrame, pause: float = 0.35, speed: float = 1.0, only: list[str] | None = None, voice_pitch: float = 0.0) -> DataFrame:
    """doc_id, style, pos, boundary, speaker, chars, emotion, intensity, words, pitch_st, rate, gain_db, pause_s, pre_pause_ms, ending, is_dialogue, fear, breaking, suspended, stressed, delivery.

    docs: doc_id, text, and speaker where it has one. The pitch is the listener's choice alone (voice_pitch): styles and
    speakers do not move it. Texts are not carried; join units by doc_id and pos for them.
    """
    spark = docs.sparkSession
    # windows sort rows of a few numbers; the style's many fields come after the last one, from a table of 13 rows
    rows = analyse(units(docs, *(["speaker"] if "speaker" in docs.columns else [])), spark, only)
    rows = marked(arc(contrast(rows.select(*[c for c in rows.columns if c not in _AFTER]))))
    nxt = F.lead("boundary").over(W.partitionBy("doc_id", "style").orderBy("pos"))
    slot = F.coalesce("slot", F.bround(F.col("pos") / F.greatest(F.lit(1), F.col("n") - 1) * 3, 0).cast("int"))
    rows = chosen_slots(rows.withColumns({"ending": F.coalesce((nxt == "para") | (F.col("boundary") == "para"), F.lit(True)), "slot": slot}))
    rows = rows.join(F.broadcast(styles(spark).select("style", *_AFTER)), "style")
    t = (F.col("intensity") - F.col("lo")) / F.greatest(F.lit(1.0), F.col("hi") - F.col("lo"))
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    moved = speaker_shift(F.col("speaker"))
    rate = (F.col("pace0") + (F.col("pace1") - F.col("pace0")) * unit) * speed * F.when(F.col("is_dialogue"), F.col("dlg_rate")).otherwise(1.0) * (1.0 + 0.02 * moved)
    gain = F.col("vol0") + (F.col("vol1") - F.col("vol0")) * unit + F.when(F.col("is_dialogue"), F.col("dlg_vol")).otherwise(0.0) + 0.25 * moved
    times = F.when(F.col("boundary") == "para", F.col("p_para")).when(F.col("boundary") == "?", F.col("p_question")).when(F.col("boundary") == "!", F.col("p_exclaim")).when(F.col("boundary") == "…", F.col("p_ellipsis")).otherwise(F.col("p_period"))
    gap = F.greatest(F.lit(0.0), F.least(F.lit(4.0), pause * times * (1.0 + (t - 0.5) * 0.5 * F.col("contrast"))))
    stress = F.col("stressed") & (t > 0.45) & (F.col("words") >= 6)
    rows = rows.withColumns({"rate": _rounded(F.greatest(F.lit(0.5), F.least(F.lit(1.6), rate)), 4), "gain": _rounded(F.greatest(F.lit(-6.0), F.least(F.lit(6.0), gain)), 2), "gap": _rounded(gap, 3), "stressed": stress, "pre": F.when(stress, F.rint(90 * F.col("micro") * t * 2)).otherwise(0.0)})
    rows = rows.withColumn("rate", F.when(F.col("ending"), F.col("rate") * F.col("end_rate")).otherwise(F.col("rate"))).withColumn("gap", F.col("gap") + F.when(F.col("ending"), pause * (F.col("end_pause") - 1.0)).otherwise(0.0))
    locked = F.greatest(F.col("lock_pace") - 0.03, F.least(F.col("lock_pace") + 0.03, F.col("rate"))) * speed
    gain = F.greatest(F.lit(-1.6), F.least(F.lit(1.6), F.greatest(F.col("lock_gain") - 0.5, F.least(F.col("lock_gain") + 0.5, F.col("gain")))))
    took = emotional(rows)
    pause_s = F.least(F.lit(4.0), _rounded(F.greatest(F.lit(0.0), F.col("gap") * F.get("pause_times", F.col("took"))), 3))
    emphasis = F.get("emphases", F.col("took"))
    pre = F.when(F.col("stressed"), F.greatest("pre", F.rint(70 * emphasis * 2))).when((emphasis >= 0.6) & (F.col("words") >= 5), F.greatest("pre", F.rint(40 * emphasis))).otherwise(F.col("pre"))
    return took.select(
        "doc_id", "style", "pos", "boundary", "speaker", "chars", "emotion", "intensity", "words", F.lit(float(voice_pitch)).alias("pitch_st"), _rounded(F.greatest(F.lit(0.5), F.least(F.lit(1.6), locked)), 4).alias("rate"), _rounded(gain, 2).alias("gain_db"),
        pause_s.alias("pause_s"), pre.cast("int").alias("pre_pause_ms"), "ending", "is_dialogue", "fear", "breaking", "suspended", "stressed", F.get("deliveries", F.col("took")).alias("delivery"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Three passes of the styles that have them: fearful lines (a third at most, the first ones), the strongest line breaks, open endings stay suspended."""
    w = W.partitionBy("doc_id", "style")
    has = F.col("style").isin(*X.EMOTIONAL)
    scared = (F.col("style") == X.FEAR["style"]) & F.col("emotion").isin(*X.FEAR["emotions"])
    rows = rows.withColumn("fear", scared & (F.sum(scared.cast("int")).over(w.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)) <= F.greatest(F.lit(1), F.floor(F.col("n") / 3))))
    first = (F.col("pos") == 0) & (F.col("n") > 1)
    rows = rows.withColumn("breaking", has & ~first & (F.col("pos") == F.max(F.struct(~first, "intensity", "pos")).over(w)["pos"]))
    return rows.withColumn("suspended", has & ~F.col("breaking") & (F.col("boundary").isin("…", "?") | F.col("open_words")))


def emotional(rows: DataFrame) -> DataFrame:
    """Pace, gain and pause of marked lines."""
    own = lambda key: reduce(lambda c, s: c.when(F.col("style") == s, X.EMOTIONAL[s][key]), X.EMOTIONAL, F)
    scale = F.greatest(F.lit(0.3), F.least(F.lit(1.0), F.col("n") / 8.0))
    rate = F.col("rate") * F.when(F.col("fear"), X.FEAR["rate"]).otherwise(1.0) * F.when(F.col("breaking"), own("break_rate")).otherwise(1.0)
    gain = F.col("gain") + F.when(F.col("fear"), X.FEAR["gain"]).otherwise(0.0) + F.when(F.col("breaking"), own("break_gain")).otherwise(0.0)
    gap = F.col("gap") + F.when(F.col("fear"), X.FEAR["pause"]).otherwise(0.0) + F.when(F.col("breaking"), own("break_after") / 1000.0 * scale).otherwise(0.0) + F.when(F.col("suspended"), own("suspend_pause") * scale).otherwise(0.0)
    return rows.withColumns({"rate": rate, "gain": gain, "gap": gap})


def pause_times(style: str) -> list[float]:
    """What each delivery of a style multiplies pauses by, inside the style's envelope."""
    lo, hi = X.PAUSE_ENVELOPE.get(style, X.PAUSE_ENVELOPE["other"])
    return [round(max(lo, min(hi, x)), 3) for _, x in X.DELIVERIES[style]]


def chosen_slots(rows: DataFrame, piece: tuple = ("doc_id", "style"), at: str = "pos") -> DataFrame:
    """rows with `took`: a line takes the next slot where its own (slot, 0 to 3) is what the line before took.

    So in a run of lines with one slot every other line moves on, and whether the first does depends on the run before:
    on its last line, if that run's slot is one lower. Runs that go up by one each are three at most (0, 1, 2; 3 does not
    move on), so two passes of windows settle it, without folding a piece in one row.
    """
    w = W.partitionBy(*piece).orderBy(at)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_before", F.lag("slot").over(w)).withColumn("_new", ~F.col("slot").eqNullSafe(F.col("_before")))
    rows = rows.withColumn("_k", F.col(at) - F.max(F.when(F.col("_new"), F.col(at))).over(upto)).withColumn("_start", F.lit(0))
    for v in (1, 2):
        moves = F.when(F.col("_new") & (F.col("slot") == v) & (F.col("_before") == v - 1), (F.lag("_start").over(w) + F.lag("_k").over(w)) % 2).otherwise(0)
        rows = rows.withColumn("_s", F.last(F.when(F.col("_new"), moves), ignorenulls=True).over(upto)).withColumn("_start", F.when(F.col("slot") == v, F.col("_s")).otherwise(F.col("_start")))
    moved = (F.col("slot") < 3) & ((F.col("_start") + F.col("_k")) % 2 == 1)
    return rows.withColumn("took", F.col("slot") + moved.cast("int")).drop("_before", "_new", "_k", "_start", "_s")


def timeline(plan: DataFrame, chars_per_second: float = 9.0, pause: float = 0.35, piece: tuple = ("doc_id", "style"), order: tuple = ("pos",)) -> DataFrame:
    """plan with gap, duration and start: the running sum of pauses, pre-pauses and durations, each in whole milliseconds, so that the order of additions does not show. Where the speaker changes, the gap is 1.6 pauses, 0.45 s at least; else the pause of the row before."""
    w = W.partitionBy(*piece).orderBy(*order)
    length, ms = F.col("chars") / chars_per_second / F.col("rate"), lambda x: F.rint(x * 1000).cast("long")
    handed = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))
    gap = F.when(F.lag("rate").over(w).isNull(), 0.0).when(handed, F.greatest(F.lit(0.45), F.lit(pause * 1.6))).otherwise(F.lag("pause_s").over(w))
    return plan.withColumn("gap", gap).withColumn("duration", length).withColumn("start", (F.sum(ms(F.col("gap")) + F.col("pre_pause_ms") + ms(length)).over(w.rowsBetween(W.unboundedPreceding, 0)) - ms(length)) / 1000.0)


def plan_lines(plan: DataFrame, docs: DataFrame, style: str) -> DataFrame:
    """doc_id and one text of a line for each sentence of a style's plan, for logs."""
    rows = plan.filter(F.col("style") == style).join(units(docs).select("doc_id", "pos", "text"), ["doc_id", "pos"])
    flag = lambda c, s: F.when(F.col(c), s).otherwise("")
    line = F.concat(
        F.format_string("%2d. %-11s I=%3d rate=%.2f pitch=%+.1fst gain=%+.1fdB pause=%.2fs", F.col("pos") + 1, "emotion", "intensity", "rate", "pitch_st", "gain_db", "pause_s"),
        flag("ending", " end"), flag("breaking", " !break"), flag("suspended", " ~~sus"), F.lit("  ["), F.col("delivery"), F.lit("]"), flag("fear", " ^fear"), F.lit("  "), F.substring("text", 1, 38),
    )
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))


def style_table(spark: SparkSession) -> DataFrame:
    """The styles in order with their label, bands, pace and pitch, as a list for readers."""
    rows = [(k, r[0], X.STYLE_PITCH[r[0]][6], r[1], r[2], r[4], r[5], X.STYLE_PITCH[r[0]][0] - X.STYLE_PITCH[r[0]][1], X.STYLE_PITCH[r[0]][0] + X.STYLE_PITCH[r[0]][1]) for k, r in enumerate(X.STYLES)]
    dim = spark.createDataFrame(rows, "no int, style string, label string, lo int, hi int, pace0 double, pace1 double, pitch0 double, pitch1 double")
    line = F.format_string("%-22s %-10s %.2f-%.2f    %+.1f..%+.1fst", F.substring("label", 1, 21), F.concat_ws("-", "lo", "hi"), "pace0", "pace1", "pitch0", "pitch1")
    return dim.withColumn("line", line).orderBy("no")
