"""DuckDB SQL of the queries whose text is long, written apart from the Spark expressions."""

from __future__ import annotations

from cantora.functions import fixed as X

_S = r"'^\s+|\s+$', '', 'g'"
_TRIM = lambda x: f"regexp_replace({x}, {_S})"

TEXT_PROFILE = rf"""
WITH t AS (SELECT doc_id, text, length(regexp_replace(text, '\s', '', 'g')) AS solid, length(regexp_replace(text, '[^\x{{1780}}-\x{{17FF}}]', '', 'g')) AS km,
  length(regexp_replace(text, '[^\x{{0E00}}-\x{{0E7F}}]', '', 'g')) AS th, len(regexp_extract_all(text, '\s+')) AS runs, {_TRIM(f"split_part({_TRIM('text')}, chr(10), 1)")} AS line, lang FROM documents)
SELECT doc_id, coalesce(km / nullif(solid, 0) > 0.3, false) AS khmer, coalesce(th / nullif(solid, 0) > 0.3, false) AS thai,
  CASE WHEN km / nullif(solid, 0) > 0.3 THEN 'km' WHEN th / nullif(solid, 0) > 0.3 THEN 'th' ELSE 'en' END AS route, CASE WHEN lang IN ('km', 'th', 'en') THEN lang WHEN km / nullif(solid, 0) > 0.3 THEN 'km' WHEN th / nullif(solid, 0) > 0.3 THEN 'th' ELSE 'en' END AS read_in,
  coalesce(regexp_matches(text, '[\p{{L}}\p{{N}}]'), false) AS speakable, (CASE WHEN runs >= 3 THEN runs + 1 ELSE greatest(1, km // 4) END)::INT AS words,
  CASE WHEN length(line) <= 70 THEN line WHEN strpos(line[:70], ' ') = 0 THEN line[:70] ELSE array_to_string(string_split(line[:70], ' ')[:-2], ' ') END AS topic FROM t
"""

CLEAN_TEXT = rf"""
WITH t AS (SELECT doc_id, text, regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS c FROM documents)
SELECT doc_id, md5({_TRIM('c')}) AS clean_md5, sha1('v1|+0%|' || text)[:24] AS unit_key FROM t
"""

_M = "line"
for _p, _to in [
    (r"\A[ \t]*#{1,6}[ \t]*", ""), (r"\A[ \t]*>+[ \t]*", ""), (r"\A[ \t]*[-*+•‣▪●][ \t]+", ""), (r"\A[ \t]*\(?[0-9]{1,3}[.)។][ \t]+", ""), (r"\A[ \t]*[០-៩]{1,3}[.)។][ \t]+", ""), (r"\*\*|__|`|\*", ""), (r"[#|]", " "), (r"\\", ""),
    (r"~~(.+?)~~", r"\1"), (r"!?\[([^\]]*)\]\([^)]*\)", r"\1"), (r"<[^>]{1,60}>", " "), (r"\A\s*[-=_~]{3,}\s*\z", " "), (r"([0-9])\s*[‐‑‒–—―−]\s*([0-9])", r"\1 to \2"), (r"[‐‑‒–—―−]", ","), (r"[ \t]+([,.;:!?។-៙])", r"\1"), (r"[ \t]{2,}", " "),
]:
    _M = f"regexp_replace({_M}, '{_p}', '{_to}', 'g')"
MANUSCRIPT = f"""
WITH l AS (SELECT page_id, generate_subscripts(string_split(html, chr(10)), 1) - 1 AS pos, unnest(string_split(html, chr(10))) AS line FROM pages)
SELECT * FROM (SELECT page_id, pos::INT AS pos, {_TRIM(_M)} AS said FROM l) WHERE said <> ''
"""


def _pieces(table: str, keys: str, stops: str, line: str) -> str:
    """Lines of texts, then pieces of lines, numbered by line and piece."""
    return f"""
l AS (SELECT {keys}, generate_subscripts(string_split(text, chr(10)), 1) AS ln, unnest(string_split(text, chr(10))) AS raw FROM {table}),
m AS (SELECT {keys}, ln, {line} AS line FROM l WHERE {_TRIM('raw')} <> ''),
q AS (SELECT {keys}, ln, line, [x for x in [{_TRIM('y')} for y in regexp_extract_all(line, '[^{stops}]*[{stops}]*')] if x <> ''] AS got FROM m),
p AS (SELECT {keys}, ln, generate_subscripts(CASE WHEN len(got) > 0 THEN got ELSE [line] END, 1) AS k, unnest(CASE WHEN len(got) > 0 THEN got ELSE [line] END) AS piece FROM q)"""


BATCH = "WITH " + _pieces("documents", "doc_id", ".!?។เ", rf"regexp_replace({_TRIM('raw')}, '^\s*(?:-|\*|•)\s+', '')")
BATCH_SENTENCES = BATCH + " SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ln, k) - 1)::INT AS pos, piece AS sentence FROM p"

UNITS = "WITH RECURSIVE " + _pieces("documents", "doc_id", ".!?…។", _TRIM("raw")) + rf""",
c AS (
  SELECT doc_id, ln, k, 0 AS i, piece AS rest, NULL::VARCHAR AS text, coalesce(nullif(regexp_extract(piece, '([.!?…។])\s*$', 1), ''), 'para') AS ending FROM p
  UNION ALL
  SELECT doc_id, ln, k, i + 1, {_TRIM('rest[cut + 1:]')}, {_TRIM('rest[:cut]')}, ending FROM (
    SELECT *, CASE WHEN strpos(reverse(rest[:450]), ' ') > 0 AND 450 - strpos(reverse(rest[:450]), ' ') >= 60 THEN 450 - strpos(reverse(rest[:450]), ' ') ELSE 450 END AS cut FROM c WHERE length(rest) > 450)
),
u AS (
  SELECT doc_id, ln, k, i, text, '.' AS boundary FROM c WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, ln, k, i + 1, rest, ending FROM c WHERE length(rest) <= 450
),
units AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ln, k, i) - 1)::INT AS pos, text, boundary FROM u WHERE text <> '')
"""

DIALOGUE_SENTENCES = f"""
WITH s AS (SELECT conv_id, turn, [x for x in [{_TRIM('y')} for y in regexp_extract_all(text, '[^.!?…]*[.!?…]+|[^.!?…]+$')] if length(x) > 1] AS f FROM conversations)
SELECT conv_id, turn, (generate_subscripts(f, 1) - 1)::INT AS pos, unnest(f) AS sentence FROM s
"""
SAMPLED = DIALOGUE_SENTENCES.split("SELECT conv_id, turn, (gen")[0] + """,
g AS (SELECT conv_id, turn, CASE WHEN len(f) <= 8 THEN f ELSE [f[round_even(i * (len(f) - 1) / 7.0, 0)::INT + 1] for i in range(8)] END AS f FROM s WHERE len(f) > 0)
SELECT conv_id, turn, (generate_subscripts(f, 1) - 1)::INT AS pos, unnest(f) AS fact FROM g
"""

CHUNKS = BATCH + """,
s AS (SELECT doc_id, list(piece ORDER BY ln, k) AS ss FROM p GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce([{'done': []::VARCHAR[], 'cur': x, 'n': 0} for x in ss], lambda a, b:
    {'done': CASE WHEN length(b.cur) > 280 THEN list_append(CASE WHEN a.cur <> '' AND (a.n >= 4 OR length(a.cur) + length(b.cur) + 1 > 280) THEN list_append(a.done, a.cur) ELSE a.done END, b.cur)
                  WHEN a.cur <> '' AND (a.n >= 4 OR length(a.cur) + length(b.cur) + 1 > 280) THEN list_append(a.done, a.cur) ELSE a.done END,
     'cur': CASE WHEN length(b.cur) > 280 THEN '' WHEN a.cur = '' OR a.n >= 4 OR length(a.cur) + length(b.cur) + 1 > 280 THEN b.cur ELSE a.cur || ' ' || b.cur END,
     'n': CASE WHEN length(b.cur) > 280 THEN 0 WHEN a.cur = '' OR a.n >= 4 OR length(a.cur) + length(b.cur) + 1 > 280 THEN 1 ELSE a.n + 1 END}, {'done': []::VARCHAR[], 'cur': '', 'n': 0}) AS r FROM s),
o AS (SELECT doc_id, CASE WHEN r.cur <> '' THEN list_append(r.done, r.cur) ELSE r.done END AS c FROM f)
SELECT doc_id, printf('chunk_%04d', i) AS cid, chunk FROM (SELECT doc_id, generate_subscripts(c, 1) AS i, unnest(c) AS chunk FROM o)
"""

CHAPTERS = f"SELECT doc_id, 1 AS num, '' AS title, md5({_TRIM('text')}) AS body_md5 FROM documents WHERE {_TRIM('text')} <> '' AND NOT regexp_matches(text, '(?im)^\\s*(chapter|ch\\.|ជំពូក)\\s*[0-9០-៩]+')"

SCRIPT_LINES = rf"""
WITH l AS (SELECT conv_id, turn, [x for x in [{_TRIM('y')} for y in string_split(text, chr(10))] if x <> ''] AS s FROM conversations),
m AS (SELECT conv_id, turn, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS line FROM l)
SELECT conv_id, turn, pos::INT AS pos, CASE WHEN hit THEN upper(regexp_extract(line, '{(n := r"(?i)^(?:HOST\s*)?\[?([AB])\]?\s*[:\-–]\s*(.*)$")}', 1)) WHEN pos % 2 = 0 THEN 'A' ELSE 'B' END AS s, CASE WHEN hit THEN regexp_extract(line, '{n}', 2) ELSE line END AS text
FROM (SELECT *, regexp_matches(line, '{n}') AS hit FROM m)
"""

_LIT = lambda x: "'" + x.replace("'", "''") + "'"
_HITS = ", ".join(f"least(3, len([w for w in [{', '.join(map(_LIT, ws))}] if contains(low, w)])) AS n_{c}" for c, ws in X.CUES.items())
_STYLE_ROWS = ", ".join("(" + ", ".join(_LIT(v) if isinstance(v, str) else repr(float(v)) + "::DOUBLE" for v in (*row, *X.WEIGHTS[row[0]])) + ")" for row in X.STYLES)
_ANY = lambda x, ws: "(" + " OR ".join(f"contains({x}, {_LIT(w)})" for w in ws) + ")"
_SPECIAL = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i)(?:{x})') THEN '{c}'" for c, x in X.SPECIAL_CUES.items()) + " END"
_FEELINGS = "[c for c in [" + ", ".join(f"CASE WHEN {_ANY('low', ws)} THEN '{c}' END" for c, ws in X.FEELING_CUES.items()) + "] if c IS NOT NULL]"
_SLOT_ROWS = ", ".join(f"('{s}', '{k}', {v})" for s, at in [*((s, {f"f_{c}": v for c, v in at.items()}) for s, at in X.FEELING_SLOT.items()), *((s, {f"s_{c}": v}) for c, at in X.SPECIAL_SLOT.items() for s, v in at.items())] for k, v in at.items())
_LIFT = {c: f"w_{c} * n_{c}" for c in X.CUES}
_EMOTION = "CASE WHEN greatest({0}) <= 0 THEN 'neutral' {1} END".format(", ".join(_LIFT.values()), " ".join(f"WHEN {x} = greatest({', '.join(_LIFT.values())}) THEN '{X.EMOTION[c]}'" for c, x in _LIFT.items()))


def _analyse(styles: tuple[str, ...]) -> str:
    return UNITS + rf""",
styles({', '.join(X.STYLE_FIELDS)}, {', '.join(f'w_{c}' for c in X.CUES)}) AS (SELECT * FROM (VALUES {_STYLE_ROWS})),
b AS (SELECT *, {_HITS}, {_SPECIAL} AS special, ({_FEELINGS})[1] AS feeling FROM (SELECT *, lower(text) AS low, len(regexp_extract_all(text, '\s+')) AS runs, max(pos) OVER (PARTITION BY doc_id) = pos AS last FROM units)),
analysed AS (
  SELECT doc_id, style, pos, text, boundary, last, low, {' + '.join(f'n_{c}' for c in X.CUES)} > 0 AS cued, (CASE WHEN runs >= 3 THEN runs + 1 ELSE greatest(1, length(regexp_replace(text, '[^\x{{1780}}-\x{{17FF}}]', '', 'g')) // 4) END)::INT AS words, regexp_matches(text, '["“”«»‘’'']') AS is_dialogue, {_EMOTION} AS emotion,
    round_even(greatest(lo, least(hi, base + ({' + '.join(f'{x} * 0.7::DOUBLE' for x in _LIFT.values())} + CASE boundary WHEN '!' THEN 10 WHEN '?' THEN 6 WHEN '…' THEN 4 ELSE 0 END
      + CASE WHEN style IN ('trailer', 'thriller', 'cinematic', 'storytelling') AND (CASE WHEN runs >= 3 THEN runs + 1 ELSE greatest(1, length(regexp_replace(text, '[^\x{{1780}}-\x{{17FF}}]', '', 'g')) // 4) END) <= 7 THEN 7 ELSE 0 END
      + CASE WHEN style IN ('documentary', 'news') AND regexp_matches(text, '[0-9]') THEN 8 ELSE 0 END + CASE WHEN last THEN 4 ELSE 0 END))), 0)::INT AS intensity, special, feeling, {', '.join(X.STYLE_FIELDS[1:])}
  FROM b CROSS JOIN styles WHERE style IN ({', '.join(map(_LIT, styles))})
)
"""


ANALYSE = _analyse(("documentary", "cinematic", "news"))

PLAN_STYLES = ["documentary", "news", "natural", "cinematic", "sad_romantic"]
_OWN = lambda k: "CASE style " + " ".join(f"WHEN '{s}' THEN {v[k]}::DOUBLE" for s, v in X.EMOTIONAL.items()) + " END"
_HAS = f"style IN ({', '.join(map(_LIT, X.EMOTIONAL))})"
_TIMES = "CASE style " + " ".join(f"WHEN '{s}' THEN {[min(max(x, lo), hi) for _, x in X.DELIVERIES[s]]}::DOUBLE[]" for s in X.DELIVERIES for lo, hi in [X.PAUSE_ENVELOPE.get(s, X.PAUSE_ENVELOPE["other"])]) + " END"
_NAMES = "CASE style " + " ".join(f"WHEN '{s}' THEN {[n for n, _ in X.DELIVERIES[s]]}" for s in X.DELIVERIES) + " END"
_OWN_CUED = " ".join(f"OR (style = '{s}' AND {_ANY('low', ws)})" for s, ws in X.OWN_STRESS.items())
_MICRO = "CASE style " + " ".join(f"WHEN '{s}' THEN {v[3]}::DOUBLE" for s, v in X.STYLE_PITCH.items()) + " END"
_EMPHASIS = "CASE style " + " ".join(f"WHEN '{s}' THEN {[X.MOVES[n][0] for n, _ in ds]}::DOUBLE[]" for s, ds in X.DELIVERIES.items()) + " END"
_PLAN = f""",
k1 AS (SELECT *, count(*) OVER w AS n, sum(intensity) OVER w / count(*) OVER w AS mean, max(intensity) OVER w - min(intensity) OVER w AS spread, (hi - lo) * contrast * 0.55 AS want FROM analysed WINDOW w AS (PARTITION BY doc_id, style)),
k2 AS (SELECT * REPLACE (CASE WHEN n >= 3 AND spread > 0 AND spread < want THEN round_even(greatest(lo, least(hi, mean + (intensity - mean) * (want / spread))), 0)::INT ELSE intensity END AS intensity), lo + (hi - lo) * 0.3 AS line FROM k1),
k3 AS (SELECT *, sum((intensity <= line)::INT) OVER (PARTITION BY doc_id, style) AS quiet, greatest(1, round_even(n * 0.25, 0)) AS need, row_number() OVER (PARTITION BY doc_id, style ORDER BY intensity, pos) AS r FROM k2),
k4 AS (SELECT * REPLACE (CASE WHEN n >= 3 AND quiet < need AND r <= need THEN round_even(least(intensity, line), 0)::INT ELSE intensity END AS intensity) FROM k3),
k4b AS (SELECT * REPLACE (CASE WHEN {_HAS} AND n >= 3 THEN round_even(greatest(lo, least(hi, intensity + ((greatest(0, least(1, 1 - abs(pos / (n - 1)::DOUBLE - peak) / greatest(peak, 1 - peak))) - 0.5) * 2 * lift - CASE WHEN pos = 0 OR last THEN lift * (1 - calm) ELSE 0 END))), 0)::INT ELSE intensity END AS intensity)
  FROM (SELECT *, CASE style WHEN 'sad_romantic' THEN 0.62::DOUBLE ELSE 0.68::DOUBLE END AS peak, CASE style WHEN 'sad_romantic' THEN 15::DOUBLE ELSE 18::DOUBLE END AS lift, CASE style WHEN 'sad_romantic' THEN 0.72::DOUBLE ELSE 0.66::DOUBLE END AS calm FROM k4)),
k5 AS (SELECT *, (intensity - lo) / greatest(1.0, hi - lo) AS t, coalesce(lead(boundary) OVER (PARTITION BY doc_id, style ORDER BY pos) = 'para' OR boundary = 'para', boundary = 'para' OR lead(boundary) OVER (PARTITION BY doc_id, style ORDER BY pos) IS NULL) AS ending FROM k4b),
k6 AS (SELECT *, round_even(greatest(0.5, least(1.6, (pace0 + (pace1 - pace0) * greatest(0, least(1, t))) * CASE WHEN is_dialogue THEN dlg_rate ELSE 1 END * (1 + 0.02::DOUBLE * coalesce(idx, 0)))), 4) AS rt,
  round_even(greatest(-6, least(6, vol0 + (vol1 - vol0) * greatest(0, least(1, t)) + CASE WHEN is_dialogue THEN dlg_vol ELSE 0 END + 0.25::DOUBLE * coalesce(idx, 0))), 2) AS gn,
  round_even(greatest(0, least(4, 0.35::DOUBLE * CASE boundary WHEN 'para' THEN p_para WHEN '?' THEN p_question WHEN '!' THEN p_exclaim WHEN '…' THEN p_ellipsis ELSE p_period END * (1 + (t - 0.5) * 0.5 * contrast))), 3) AS gp,
  t > 0.45 AND words >= 6 AND (cued {_OWN_CUED}) AS stressed FROM k5 LEFT JOIN spk USING (doc_id)),
k7 AS (SELECT * REPLACE (CASE WHEN ending THEN rt * end_rate ELSE rt END AS rt, gp + CASE WHEN ending THEN 0.35::DOUBLE * (end_pause - 1) ELSE 0 END AS gp), greatest(0.3::DOUBLE, least(1, n / 8::DOUBLE)) AS scale,
  style = 'cinematic' AND emotion IN ('tension', 'revelation') AND sum((style = 'cinematic' AND emotion IN ('tension', 'revelation'))::INT) OVER (PARTITION BY doc_id, style ORDER BY pos) <= greatest(1, n // 3) AS fear,
  {_HAS} AND (pos > 0 OR n = 1) AND row_number() OVER (PARTITION BY doc_id, style, pos = 0 AND n > 1 ORDER BY intensity DESC, pos DESC) = 1 AS breaking FROM k6),
k8 AS (SELECT *, {_HAS} AND NOT breaking AND (boundary IN ('…', '?') OR {_ANY('text', X.SUSPEND_CUES)}) AS suspended FROM k7),
slots(style, kind, v) AS (SELECT * FROM (VALUES {_SLOT_ROWS})),
k9 AS (SELECT k8.*, coalesce(a.v, f.v, CASE WHEN emotion = 'neutral' THEN p.v END, round_even(pos / greatest(1, n - 1)::DOUBLE * 3, 0))::INT AS slot FROM k8
  LEFT JOIN slots a ON a.style = k8.style AND a.kind = 's_' || special LEFT JOIN slots f ON f.style = k8.style AND f.kind = 'f_' || feeling LEFT JOIN slots p ON p.style = k8.style AND p.kind = 'f_peace'),
chosen AS (SELECT doc_id, style, generate_subscripts(r.took, 1) - 1 AS pos, unnest(r.took) AS took FROM (SELECT doc_id, style, list_reduce([{{'prev': x, 'took': []::INT[]}} for x in list(slot ORDER BY pos)], lambda a, b:
  {{'prev': CASE WHEN b.prev = a.prev AND b.prev < 3 THEN b.prev + 1 ELSE b.prev END, 'took': list_append(a.took, CASE WHEN b.prev = a.prev AND b.prev < 3 THEN b.prev + 1 ELSE b.prev END)}}, {{'prev': -1, 'took': []::INT[]}}) AS r FROM k9 GROUP BY doc_id, style)),
plan AS (SELECT doc_id, style, pos, text, speaker, CASE WHEN stressed THEN greatest(round_even(90 * ({_MICRO}) * t * 2, 0), round_even(70 * ({_EMPHASIS})[took + 1] * 2, 0)) WHEN ({_EMPHASIS})[took + 1] >= 0.6 AND words >= 5 THEN round_even(40 * ({_EMPHASIS})[took + 1], 0) ELSE 0 END::INT AS pre_pause_ms, emotion, intensity, words, round_even(greatest(0.5, least(1.6, greatest(lock_pace - 0.03, least(lock_pace + 0.03, rt * CASE WHEN fear THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN breaking THEN {_OWN('break_rate')} ELSE 1 END)))), 4) AS rate,
  round_even(greatest(-1.6, least(1.6, greatest(lock_gain - 0.5, least(lock_gain + 0.5, gn + CASE WHEN fear THEN -3 ELSE 0 END + CASE WHEN breaking THEN {_OWN('break_gain')} ELSE 0 END)))), 2) AS gain_db,
  least(4, round_even(greatest(0, (gp + CASE WHEN fear THEN 0.25 ELSE 0 END + CASE WHEN breaking THEN {_OWN('break_after')} / 1000 * scale ELSE 0 END + CASE WHEN suspended THEN {_OWN('suspend_pause')} * scale ELSE 0 END) * ({_TIMES})[took + 1]), 3)) AS pause_s,
  ending, is_dialogue, fear, breaking, suspended, ({_NAMES})[took + 1] AS delivery FROM k9 JOIN chosen USING (doc_id, style, pos))
"""

def plan_sql(styles: list[str], source: str = "spk AS (SELECT NULL::BIGINT AS doc_id, 0 AS idx, NULL::VARCHAR AS speaker WHERE false)") -> str:
    """The plan's CTEs over documents, or over the table that source puts in their place with its speakers."""
    return _analyse(tuple(styles)).replace("WITH RECURSIVE ", f"WITH RECURSIVE {source}, ", 1) + _PLAN


SPOKEN = """documents AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations),
spk AS (SELECT conv_id * 1000 + turn AS doc_id, role AS speaker, list_sum([ord(c) for c in string_split(role, '')]) % 3 - 1 AS idx FROM conversations)"""
PLAN = plan_sql(PLAN_STYLES)
TIMELINE = """,
g AS (SELECT *, coalesce(lag(pause_s) OVER (PARTITION BY doc_id, style ORDER BY pos), 0) AS gap, length(text) / 9.0::DOUBLE / rate AS dur FROM plan)
SELECT doc_id, style, pos, round_even(gap, 3) AS gap, round_even((sum(round_even(gap * 1000, 0)::BIGINT + pre_pause_ms + round_even(dur * 1000, 0)::BIGINT) OVER (PARTITION BY doc_id, style ORDER BY pos) - round_even(dur * 1000, 0)::BIGINT) / 1000.0::DOUBLE, 3) AS start FROM g
"""
DIALOGUE_TIMELINE = """,
g AS (SELECT *, doc_id // 1000 AS conv_id, CASE WHEN lag(rate) OVER w IS NULL THEN 0 WHEN lag(speaker) OVER w IS DISTINCT FROM speaker THEN greatest(0.45::DOUBLE, 0.35::DOUBLE * 1.6) ELSE lag(pause_s) OVER w END AS gap, length(text) / 9.0::DOUBLE / rate AS dur FROM plan WINDOW w AS (PARTITION BY doc_id // 1000 ORDER BY doc_id, pos))
SELECT conv_id, doc_id, pos, round_even(gap, 3) AS gap, round_even((sum(round_even(gap * 1000, 0)::BIGINT + pre_pause_ms + round_even(dur * 1000, 0)::BIGINT) OVER (PARTITION BY conv_id ORDER BY doc_id, pos) - round_even(dur * 1000, 0)::BIGINT) / 1000.0::DOUBLE, 3) AS start FROM g
"""


def _words(values: list[str], at: str) -> str:
    return f"[{', '.join(map(_LIT, values))}][{at} + 1]"


def _thousand(n: str) -> str:
    return f"(CASE WHEN {n} // 100 > 0 THEN {_words(X.ONES, f'({n} // 100)')} || '{X.HUNDRED}' ELSE '' END || CASE WHEN {n} % 100 >= 10 THEN {_words(X.TENS, f'({n} % 100 // 10)')} || CASE WHEN {n} % 10 > 0 THEN {_words(X.ONES, f'({n} % 10)')} ELSE '' END WHEN {n} % 100 > 0 THEN {_words(X.ONES, f'({n} % 100)')} ELSE '' END)"


def _million(n: str) -> str:
    scale = lambda by, below, word: f"CASE WHEN {n} % {below} // {by} > 0 THEN {_words(X.ONES, f'({n} % {below} // {by})')} || '{word}' ELSE '' END"
    return f"({scale(100000, 1000000, X.HUNDRED_THOUSAND)} || {scale(10000, 100000, X.TEN_THOUSAND)} || {scale(1000, 10000, X.THOUSAND)} || {_thousand(f'({n} % 1000)')})"


NUMBERS = f"""
WITH x AS (SELECT DISTINCT l_orderkey * 137 + l_linenumber AS n FROM lineitem)
SELECT n, CASE WHEN n = 0 THEN '{X.ONES[0]}' ELSE CASE WHEN n >= 1000000 THEN {_million('(n // 1000000)')} || '{X.MILLION}' ELSE '' END || {_million('(n % 1000000)')} END AS words,
  '{X.ORDINAL}' || CASE WHEN n % 1000 = 0 THEN '{X.ONES[0]}' ELSE {_thousand('(n % 1000)')} END AS ordinal, array_to_string([{_words(X.ONES, 'c::INT')} for c in string_split(n::VARCHAR, '')], ' ') AS digits,
  printf('%+d%%', round_even(((n % 100) / 50.0::DOUBLE - 1) * 100, 0)::INT) AS rate, printf('%02d:%02d', n % 5000 // 60, n % 5000 % 60) AS clock FROM x
"""

STYLE_IDS = "SELECT * FROM (VALUES " + ", ".join(f"({_LIT(a)}, {_LIT(b)})" for a, b in [*((s[0], s[0]) for s in X.STYLES), *X.STYLE_ALIASES.items(), ("News-Anchor", "news"), (" Thriller ", "thriller"), ("no such style", "natural")]) + ") v(name, style)"

BATCHES = """
WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS m FROM events),
r AS (
  SELECT user_id, i, m, 1::BIGINT AS n, value AS total, 0 AS batch FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, i, m, CASE WHEN opens THEN 1 ELSE n + 1 END, CASE WHEN opens THEN value ELSE total + value END, CASE WHEN opens THEN batch + 1 ELSE batch END
  FROM (SELECT e.user_id, e.i, e.m, e.value, r.n, r.total, r.batch, r.n >= 16 OR r.total >= 337.5 OR r.total + e.value > 450 AS opens FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
)
SELECT user_id, batch, max(n)::INT AS n, round_even(arg_max(total, i), 4) AS total FROM r GROUP BY user_id, batch
"""

FEELINGS = UNITS + f"""SELECT doc_id, pos, found, coalesce(map({list(X.FEELING_EMOTION)}, {list(X.FEELING_EMOTION.values())})[list_sort([{{'far': abs(coalesce(map({list(X.FEELING_SLOT['documentary'])}, {list(X.FEELING_SLOT['documentary'].values())})[c], 1) - 1), 'i': list_position(found, c), 'c': c}} for c in found])[1].c], 'neutral') AS emotion
FROM (SELECT doc_id, pos, {_FEELINGS} AS found FROM (SELECT *, lower(text) AS low FROM units))"""

_MEASURES = "SELECT l_orderkey, l_linenumber, 15 + l_quantity AS snr_db, -30 - l_quantity AS noise_db, CASE WHEN l_linenumber <> 4 THEN l_discount END AS reverb, l_tax / 2 AS rumble, l_quantity / 5 AS mud, l_discount / 8 AS presence, l_tax * 30 AS sibilance, CASE WHEN l_linenumber <> 2 THEN l_quantity / 3 END AS wander_db, l_discount AS clip_pct, -10 - l_quantity / 2 AS speech_db FROM lineitem"
_R = lambda x, p: f"round_even(({x}) * {10.0**p}::DOUBLE, 0) / {10.0**p}::DOUBLE"
_CLIPS = f"""
WITH m AS ({_MEASURES}),
s AS (SELECT *, greatest(0, least(100, round_even(100
  - CASE WHEN snr_db < 45 THEN least(22, (45 - snr_db) * 0.9::DOUBLE) ELSE 0 END - CASE WHEN reverb > 0.025::DOUBLE AND snr_db > 45 THEN least(18, (reverb - 0.025::DOUBLE) * 300) ELSE 0 END
  - CASE WHEN rumble > 0.02::DOUBLE THEN least(10, (rumble - 0.02::DOUBLE) * 40) ELSE 0 END - CASE WHEN mud > 7 THEN least(10, (mud - 7) * 3) ELSE 0 END
  - CASE WHEN presence < 0.008::DOUBLE THEN least(10, (0.008::DOUBLE - presence) * 400) ELSE 0 END - CASE WHEN sibilance > 1.2::DOUBLE THEN least(8, (sibilance - 1.2::DOUBLE) * 6) ELSE 0 END
  - CASE WHEN wander_db > 10 THEN least(8, (wander_db - 10) * 1.5::DOUBLE) ELSE 0 END - CASE WHEN clip_pct > 0.01::DOUBLE THEN least(12, clip_pct * 200) ELSE 0 END, 0)))::INT AS score FROM m),
t AS (SELECT *, greatest(0, least(1, (100 - score) / 100.0::DOUBLE)) AS st FROM s),
g AS (SELECT *, 0.6::DOUBLE + 0.4::DOUBLE * st AS grow FROM t)
"""
CLIP_PLANS = _CLIPS + f""",
p AS (SELECT l_orderkey, l_linenumber, score, CASE WHEN score < 40 THEN 'poor' WHEN score < 60 THEN 'needs cleanup' WHEN score < 80 THEN 'moderate' ELSE 'good' END AS band, {_R('st', 3)} AS strength,
  CASE WHEN snr_db < 42 THEN {_R('least(20, 6 + 14 * least(1, (42 - snr_db) / 22) * grow)', 1)} END AS denoise, CASE WHEN snr_db < 42 THEN {_R('greatest(-60, least(-30, noise_db))', 1)} END AS noise_gate,
  CASE WHEN reverb > 0.02::DOUBLE THEN {_R('greatest(0.1::DOUBLE, least(0.5::DOUBLE, 0.2::DOUBLE + (reverb - 0.02::DOUBLE) * 7) * grow)', 3)} END AS dereverb,
  CASE WHEN rumble > 0.02::DOUBLE THEN CASE WHEN st < 0.5 THEN 70 WHEN st < 0.8 THEN 80 ELSE 90 END END AS highpass,
  CASE WHEN mud > 7 THEN {_R('-(least(2, 0.5::DOUBLE + (mud - 7) * 0.35::DOUBLE) * grow)', 2)} END AS low_mid,
  CASE WHEN presence < 0.008::DOUBLE THEN {_R('greatest(0.25::DOUBLE, least(1.6::DOUBLE, 0.5::DOUBLE + (0.008::DOUBLE - presence) * 40) * grow)', 2)} END AS clarity,
  CASE WHEN sibilance > 1.2::DOUBLE THEN {_R('least(3, 0.8::DOUBLE + (sibilance - 1.2::DOUBLE) * 1.2::DOUBLE) * grow', 2)} END AS deess,
  CASE WHEN wander_db > 10 THEN {_R('2 + least(1, (wander_db - 10) / 8)', 1)} WHEN st > 0.25 THEN {_R('2 + least(1, st)', 1)} END AS ratio,
  CASE WHEN wander_db > 10 THEN {_R('greatest(-40, least(-12, speech_db - 4))', 1)} WHEN st > 0.25 THEN {_R('greatest(-40, least(-12, speech_db - 3))', 1)} END AS threshold FROM g)
SELECT *, [x for x in [CASE WHEN denoise IS NOT NULL THEN 'noise reduction' END, CASE WHEN dereverb IS NOT NULL THEN 'de-reverb' END, CASE WHEN highpass IS NOT NULL THEN 'rumble filter' END, CASE WHEN low_mid IS NOT NULL THEN 'low-mid' END,
  CASE WHEN clarity IS NOT NULL THEN 'presence' END, CASE WHEN deess IS NOT NULL THEN 'harshness' END, CASE WHEN ratio IS NOT NULL THEN 'gentle compression' END] if x IS NOT NULL] AS stages FROM p
"""
CLIP_CHANGES = f"""
WITH m AS ({_MEASURES}), b AS (SELECT l_orderkey, l_linenumber - 1 AS l_linenumber, sibilance, rumble, snr_db, noise_db, presence FROM m),
w AS (SELECT l_orderkey, l_linenumber, [x for x in [CASE WHEN b.sibilance > greatest(1.2::DOUBLE, a.sibilance * 1.35::DOUBLE) THEN 'added harshness' END, CASE WHEN b.rumble > a.rumble * 1.5::DOUBLE + 0.01::DOUBLE THEN 'added low rumble' END,
  CASE WHEN b.snr_db < a.snr_db - 3 AND b.noise_db > -70 THEN 'made the noise floor worse' END, CASE WHEN b.presence < a.presence * 0.6::DOUBLE THEN 'lost clarity' END] if x IS NOT NULL] AS worse FROM m a JOIN b USING (l_orderkey, l_linenumber))
SELECT *, CASE WHEN len(worse) = 0 THEN 'done' ELSE 'redo' END AS step FROM w
"""
CLIP_CHECKS = f"""
WITH c AS (SELECT event_id, CASE event_type WHEN 'click' THEN 6000 ELSE 44100 END AS rate, (event_id % 3 + 1)::INT AS channels, (value - 5) / 10 AS seconds, value / 100 AS peak, value / 5000 AS rms FROM events),
f AS (SELECT *, [x for x in [CASE WHEN rate < 8000 THEN 'implausible sample rate' END, CASE WHEN channels NOT IN (1, 2) THEN 'unexpected channel count' END, CASE WHEN seconds <= 0 THEN 'zero duration' END, CASE WHEN seconds > 0 AND seconds < 0.2::DOUBLE THEN 'too short' END] if x IS NOT NULL] AS form FROM c)
SELECT event_id, CASE WHEN len(form) > 0 THEN form ELSE [x for x in [CASE WHEN peak > 0.999::DOUBLE THEN 'clipping' END, CASE WHEN rms < 0.002::DOUBLE THEN 'silent' END] if x IS NOT NULL] END AS problems,
  CASE WHEN peak > 0.5::DOUBLE THEN 'clipping' WHEN rms * 1000 - 40 > -38 THEN 'noisy' WHEN seconds < 2 THEN 'too short' END AS flag,
  CASE WHEN seconds * 40 = 0 THEN 'unmeasured' WHEN seconds * 40 < 155 THEN 'male range' WHEN seconds * 40 < 165 THEN 'low / androgynous range' ELSE 'female range' END AS pitch_range FROM f
"""
WHOLE_READINGS = r"""
WITH n AS (SELECT doc_id, n_chars / (doc_id % 40 + 10)::DOUBLE AS est, greatest(0.4::DOUBLE, 0.22::DOUBLE * len(regexp_extract_all(text, '\S+')), 0.03::DOUBLE * length(text)) AS need FROM documents)
SELECT doc_id, round_even(need, 3) AS need_s, CASE WHEN est >= need * 1.25::DOUBLE THEN true WHEN est < need * 0.6::DOUBLE THEN false ELSE est * 1.02::DOUBLE >= need END AS complete FROM n
"""
GUARDED = f"""
WITH v AS (SELECT DISTINCT l_quantity AS q FROM lineitem)
SELECT q, {_R("0.25::DOUBLE * tanh((q / 10 - 2) / 0.25::DOUBLE)", 3)} AS pitch, {_R("0.8::DOUBLE * tanh((q / 5 - 5) / 0.8::DOUBLE)", 2)} AS gain, {_R("greatest(0.94::DOUBLE, least(1.06::DOUBLE, q / 25))", 4)} AS pace,
  round_even(150 * (pow(2.0::DOUBLE, (q - 25) / 12) - 1), 0)::INT AS hz, greatest(0.5::DOUBLE, least(1.5::DOUBLE, q / 20)) AS speed FROM v
"""
_NAMED = next(s for s in X.STYLES if s[0] == "documentary")
ARC = rf"""
WITH s AS (SELECT doc_id, [x for x in string_split(regexp_replace(text, '([.!?។៕៖])\s+', '\1' || chr(1), 'g'), chr(1)) if {_TRIM('x')} <> ''] AS ss FROM documents),
e AS (SELECT doc_id, len(ss) AS n, generate_subscripts(ss, 1) - 1 AS i, unnest(ss) AS x FROM s),
c AS (SELECT *, first_value(i) OVER (PARTITION BY doc_id ORDER BY CASE WHEN i < n - 1 THEN length(x) ELSE 0 END DESC, i DESC) AS top0 FROM e),
p AS (SELECT *, i / greatest(1, n - 1)::DOUBLE AS t, CASE WHEN top0 = 0 AND n > 2 THEN n - 2 ELSE top0 END AS top FROM c),
q AS (SELECT *, CASE WHEN n = 1 THEN 'whole' WHEN i = top THEN 'climax' WHEN i > top THEN 'release' WHEN t < 0.25 THEN 'opening' WHEN t < 0.65 THEN 'build' ELSE 'turn' END AS phase FROM p)
SELECT doc_id, i::INT AS index, phase, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE t END AS share, round_even(greatest({_NAMED[1]}, least({_NAMED[2]}, {_NAMED[1]} + {_NAMED[2] - _NAMED[1]} * CASE phase {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in X.PHASE_SHARE.items())} END)), 0)::INT AS intensity FROM q
"""
_SIGNS = "VALUES " + ", ".join(f"({_LIT(k)}, {_LIT(a)}, {b})" for k, (a, b) in X.PAUSE_SIGNS.items())
MARKS = f"""
WITH c AS (SELECT conv_id, turn, generate_subscripts(string_split(text, ''), 1) - 1 AS spot, unnest(string_split(text, '')) AS sign FROM conversations), s(sign, plain, level) AS ({_SIGNS})
SELECT conv_id, turn, spot::INT AS spot, sign, plain, level FROM c JOIN s USING (sign)
"""
_TOKEN = r"\x01[^\x01]*\x01|[ក-អ](?:\.[ក-អ]){1,4}\.?|[ក-៓]+|[A-Za-z0-9]+(?:[’''&-][A-Za-z0-9]+)*|[.!?,;:…%]+|[^\s]"
TOKENS = f"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '{_TOKEN}') AS t FROM conversations)
SELECT conv_id, turn, len(t)::INT AS n, md5(array_to_string([CASE WHEN i = 1 OR contains({_LIT(X.JOIN_LEFT)}, x[1]) OR contains({_LIT(X.JOIN_RIGHT)}, t[i - 1][-1]) THEN x ELSE ' ' || x END for x, i in t], '')) AS joined_md5 FROM t
"""
NARRATOR_CHUNKS = "WITH RECURSIVE " + _pieces("documents", "doc_id", ".!?…เ", _TRIM("raw")) + f""",
c AS (SELECT doc_id, ln, k, 0 AS i, piece AS rest, NULL::VARCHAR AS t FROM p
  UNION ALL SELECT doc_id, ln, k, i + 1, {_TRIM('rest[2201:]')}, {_TRIM('rest[:2200]')} FROM c WHERE length(rest) > 2200),
u AS (SELECT doc_id, ln, k, i, t, true AS whole FROM c WHERE t IS NOT NULL UNION ALL SELECT doc_id, ln, k, i + 1, rest, false FROM c WHERE length(rest) <= 2200),
s AS (SELECT doc_id, list({{'done': []::VARCHAR[], 'cur': t, 'whole': whole}} ORDER BY ln, k, i) AS us FROM u GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(us, lambda a, b:
  {{'done': list_concat(CASE WHEN a.cur <> '' AND (b.whole OR length(a.cur) + length(b.cur) + 1 > 2200) THEN list_append(a.done, a.cur) ELSE a.done END, CASE WHEN b.whole THEN [b.cur] ELSE [] END),
    'cur': CASE WHEN b.whole THEN '' WHEN a.cur = '' OR length(a.cur) + length(b.cur) + 1 > 2200 THEN b.cur ELSE {_TRIM("a.cur || ' ' || b.cur")} END, 'whole': false}}, {{'done': []::VARCHAR[], 'cur': '', 'whole': false}}) AS r FROM s),
o AS (SELECT doc_id, [x for x in list_append(r.done, r.cur) if x <> ''] AS c FROM f)
SELECT doc_id, (generate_subscripts(c, 1) - 1)::INT AS pos, unnest(c) AS chunk FROM o
"""
READING = UNITS + """,
r AS (SELECT doc_id, pos, row_number() OVER w AS place, sum(length(text)) OVER w AS s, length(text) AS n FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
k AS (SELECT * FROM r WHERE place = 1 OR (s - n) / 9.0::DOUBLE < 60)
SELECT doc_id, pos, place::INT AS place, round_even(s / 9.0::DOUBLE, 3) AS running_s, place % 10 = 0 OR place = max(place) OVER (PARTITION BY doc_id) AS mark FROM k
"""
PASSAGES = """
WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spot FROM events), f AS (SELECT * FROM a WHERE value > 60),
g AS (SELECT *, coalesce(spot - lag(spot) OVER (PARTITION BY user_id ORDER BY spot) > 4, true)::INT AS new FROM f), h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY spot) AS passage FROM g)
SELECT user_id, passage::BIGINT AS passage, (max(spot) - min(spot) + 1)::INT AS length, min(spot)::INT AS first_at, max(spot)::INT AS last_at, max(value) AS peak FROM h GROUP BY user_id, passage
"""
_NUMBER = r"\b(\d+(?:[.,]\d+)*(?:st|nd|rd|th)?)\s+([A-Za-z]{3,}(?:\s+[A-Za-z]{3,})?)\b"
_SPAN = r"\b[A-Z][a-z]{2,}(?:''s)?\b(?:\s+[A-Z][a-z]{2,}(?:''s)?\b){0,2}"
# RE2's word boundary knows ASCII only, so Latin letters beyond it become word signs first
_PLAIN = lambda x: rf"regexp_replace({x}, '[\x{{C0}}-\x{{24F}}]', '_', 'g')"
_STOP = "[" + ", ".join(map(_LIT, X.NOT_NAMES)) + "]"
_NAME = lambda x: f"[n for n in regexp_extract_all({_PLAIN(x)}, '{_SPAN}') if regexp_matches(n, '\\s') OR (NOT list_contains({_STOP}, regexp_replace(n, '[''s]+$', '')) AND NOT starts_with({x}, n))][1]"
_NUM = lambda x: f"nullif(regexp_extract({_PLAIN(x)}, '{_NUMBER}', 0), '')"
_FILL = lambda p, *v: " || ".join(x for x in [_LIT(p.split("{}")[0]), *(y for a, b in zip(v, p.split("{}")[1:], strict=True) for y in (a, _LIT(b)))])
_TEASE = lambda k: "[" + ", ".join(map(_LIT, X.HOST_TEASERS[k])) + "][same % 3 + 1]"
_ENDS = "[ \t\"''“”—–:-]+"
HOSTS = rf"""
WITH t0 AS (SELECT conv_id, turn, coalesce(text, '') AS text, [x for x in [{_TRIM('y')} for y in regexp_extract_all(coalesce(text, ''), '[^.!?…]*[.!?…]+|[^.!?…]+$')] if length(x) > 1] AS sents,
  regexp_replace(regexp_replace({_TRIM(f"split_part({_TRIM('text')}, chr(10), 1)")}, '^{_ENDS}', ''), '{_ENDS}$', '') AS line FROM conversations),
t1 AS (SELECT conv_id, turn, text, sents, [x for x in sents if len(regexp_extract_all(x, '\S+')) >= 6] AS long,
  CASE WHEN {_TRIM('text')} = '' THEN 'this topic' ELSE regexp_replace(CASE WHEN length(line) <= 70 THEN line WHEN contains(line[:70], ' ') THEN array_to_string(string_split(line[:70], ' ')[:-2], ' ') ELSE line[:70] END, '[ .,:;—…-]+$', '') END AS topic FROM t0),
t2 AS (SELECT conv_id, turn, topic, CASE WHEN len(long) > 0 THEN long WHEN len(sents) > 0 THEN sents ELSE [{_TRIM('text')}] END AS f FROM t1),
t3 AS (SELECT conv_id, turn, topic, CASE WHEN len(f) > 8 THEN [f[round_even(i * (len(f) - 1) / 7.0, 0)::INT + 1] for i in range(8)] ELSE f END AS f FROM t2),
e AS (SELECT conv_id, turn, topic, len(f) AS n, generate_subscripts(f, 1) - 1 AS i, unnest(f) AS f FROM t3),
s AS (SELECT *, {_NUM('f')} AS num, {_NAME('f')} AS nm FROM e),
k AS (SELECT *, CASE WHEN num IS NOT NULL THEN 'number' WHEN nm IS NOT NULL THEN 'name' ELSE 'idea' END AS kind, coalesce(num, nm) AS sal FROM s),
r AS (SELECT *, count(*) FILTER (WHERE i > 0) OVER (PARTITION BY conv_id, turn, kind ORDER BY i) - 1 AS same FROM k),
z AS (SELECT conv_id, turn, topic, max(n) AS n, arg_min(coalesce(sal, ''), i) AS s0, arg_max(coalesce(sal, ''), i) AS s1, regexp_extract_all(topic, '\S+') AS w FROM k GROUP BY conv_id, turn, topic),
y AS (SELECT *, CASE WHEN len(w) > 7 THEN regexp_replace(array_to_string(w[:7], ' '), '[,;: ]+$', '') ELSE topic END AS short FROM z),
o AS (
  SELECT conv_id, turn, 0 AS pos, 'A' AS s, CASE WHEN len(w) > 6 THEN {_FILL(X.HOST_INTRO["sentence"], "array_to_string(w[:5], ' ')")} ELSE {_FILL(X.HOST_INTRO["title"], "topic")} END AS text FROM y
  UNION ALL SELECT conv_id, turn, 1, 'B', {_LIT(X.HOST_INTRO["reply"])} FROM y
  UNION ALL SELECT conv_id, turn, 2 + 2 * i, CASE WHEN i % 2 = 0 THEN 'A' ELSE 'B' END, CASE WHEN i = 0 THEN {_LIT(X.HOST_INTRO["first"])} || f ELSE f END FROM r
  UNION ALL SELECT conv_id, turn, 1 + 2 * i, CASE WHEN i % 2 = 0 THEN 'B' ELSE 'A' END, CASE kind WHEN 'number' THEN {_TEASE('number')} WHEN 'name' THEN replace({_TEASE('name')}, '{{sal}}', sal) ELSE {_TEASE('idea')} END FROM r WHERE i > 0
  UNION ALL SELECT conv_id, turn, 1 + 2 * n, 'A', CASE WHEN s1 <> '' AND NOT contains(short, s1) THEN {_FILL(X.HOST_OUTRO["detail"], "s1")} WHEN s0 <> '' AND s1 <> '' AND s0 <> s1 AND NOT contains(short, s0) THEN {_FILL(X.HOST_OUTRO["span"], "short", "s0", "s1")} ELSE {_FILL(X.HOST_OUTRO["plain"], "short")} END FROM y
  UNION ALL SELECT conv_id, turn, 2 + 2 * n + g.j, CASE g.j WHEN 1 THEN 'A' ELSE 'B' END, {_LIT(X.HOST_OUTRO["last"][0])} AS t FROM y, (VALUES (0)) g(j)
  UNION ALL SELECT conv_id, turn, 3 + 2 * n, 'A', {_LIT(X.HOST_OUTRO["last"][1])} FROM y
  UNION ALL SELECT conv_id, turn, 4 + 2 * n, 'B', {_LIT(X.HOST_OUTRO["last"][2])} FROM y)
SELECT conv_id, turn, pos::INT AS pos, s, text FROM o
"""


# -- the language front end: sentences put together from columns, and what must be said for them --

_NUM = lambda n: f"CASE WHEN ({n}) = 0 THEN '{X.ONES[0]}' ELSE CASE WHEN ({n}) >= 1000000 THEN {_million(f'({n}) // 1000000')} || '{X.MILLION}' ELSE '' END || {_million(f'({n})')} END"
VERBALIZED = f"""
WITH x AS (SELECT DISTINCT l_orderkey % 24 AS h, l_linenumber * 7 AS mi, l_orderkey % 28 + 1 AS d, l_linenumber AS mo, 1900 + l_orderkey % 150 AS y, l_partkey * 1013 AS p, l_quantity::BIGINT AS q FROM lineitem)
SELECT h, mi, d, mo, y, p, q, 'at ' || {_NUM('h')} || ' ម៉ោង ' || {_NUM('mi')} || ' នាទី on ថ្ងៃទី ' || {_NUM('d')} || ' ខែ ' || {_words(X.MONTHS, '(mo - 1)')} || ' ឆ្នាំ ' || {_NUM('y')}
  || ' for ' || {_NUM('p')} || 'ដុល្លារ and ' || {_NUM('q')} || 'ភាគរយ of {X.ORDINAL}' || {_NUM('q')} || ' by ' || {_NUM('q')} || 'នាក់ or ' || {_NUM('q')} || ' {X.POINT} ' || {_NUM('d')} || ' then ' || {_NUM('p')} AS said,
  1 AS time, 1 AS date, 1 AS currency, 1 AS percent, 1 AS ordinal, 1 AS unit, 1 AS decimal, 1 AS number FROM x
"""

_FORMS = {k: v for k, v in X.ABBREVIATIONS.items() if not k.endswith(".")}
SHORT_FORMS = f"""
WITH x AS (SELECT DISTINCT l_orderkey % {len(_FORMS)} AS f, l_linenumber AS n FROM lineitem)
SELECT f, n, replace('a ' || {_words(list(_FORMS.values()), 'f')} || CASE WHEN n % 2 = 0 THEN ' ' || {_NUM('n')} ELSE '' END || ' អ.ព ' || {_words(list(_FORMS.values()), 'f')} || ' z', 'សង់ទីម៉ែត្រ', 'សង់ ទី ម៉ែត្រ') AS said, 2 AS known, ['អ.ព'] AS unknown FROM x
"""

REPEATED = "SELECT * FROM (VALUES " + ", ".join(f"({_LIT(w)}, {_LIT(f'{w} {w}ដោយ x')}, true)" for w in X.REPEATED) + ", ('ចកវ', 'ចកវ ចកវដោយ x', false)) v(word, said, sure)"
PROTECTED = "SELECT * FROM (VALUES " + ", ".join(f"({_LIT(w)}, 'x ' || chr(1) || {_LIT(w)} || chr(1) || ' y')" for w in X.NAMES) + ") v(term, fenced)"

_HIDDEN = r"regexp_replace(nfc_normalize(text), '[\x00-\x08\x0b-\x1f\x7f-\x9f\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', '', 'g')"
SAFE = f"SELECT doc_id, md5({_TRIM(_HIDDEN)}) AS safe_md5 FROM documents WHERE text IS NOT NULL"

_L, _COUNTS = "raw", "0"
for _p, _to in [(r"^\s*#{1,6}\s*", ""), (r"\s*#{1,6}\s*$", ""), (r"\*\*(.+?)\*\*|__(.+?)__", r"\1\2"), (r"`([^`]*)`", r"\1"), (r"^\s*[•●▪–—\-\*]\s+", ""), (r"^\s*(?:[0-9]{1,3}|[០-៩]{1,3})[.)]\s+", "")]:
    _COUNTS, _L = f"{_COUNTS} + len(regexp_extract_all({_L}, '{_p}'))", f"regexp_replace({_L}, '{_p}', '{_to}', 'g')"
_RAW_BLANKS = r"[\x{a0}\x{2007}\x{202f}\x{2009}\x{200a}\t]"
_PLAIN_QUOTES = "regexp_replace(regexp_replace(n, '[“”„‟«»]', '\"', 'g'), '[‘’′]', chr(39), 'g')"
_JOINED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, ' {2,}', ' ', 'g'), '([0-9])\s*[–—―]\s*([0-9])', '\1 ដល់ \2', 'g'), '\s*[–—―]\s*', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
CLEANED = rf"""
WITH t AS (SELECT doc_id, nfc_normalize(text) AS n FROM documents WHERE text IS NOT NULL),
z AS (SELECT doc_id, (length(n) - length(replace(n, chr(8203), '')))::INT AS zwsp, replace(regexp_replace(regexp_replace(n, '([\x{{17B4}}-\x{{17D3}}])\x{{200B}}', '\1', 'g'), '\x{{200B}}([\x{{17B4}}-\x{{17D3}}])', '\1', 'g'), chr(8203), ' ') AS n FROM t),
b AS (SELECT doc_id, zwsp, len(regexp_extract_all(n, '{_RAW_BLANKS}'))::INT AS nbsp, regexp_replace(n, '{_RAW_BLANKS}', ' ', 'g') AS n FROM z),
c AS (SELECT doc_id, zwsp, nbsp, len([x for x in regexp_extract_all(n, '\p{{Cf}}') if ord(x) NOT IN (8204, 8205)])::INT AS control, replace(replace(regexp_replace(replace(replace(n, chr(8204), chr(57345)), chr(8205), chr(57346)), '\p{{Cf}}', '', 'g'), chr(57345), chr(8204)), chr(57346), chr(8205)) AS n FROM b),
l AS (SELECT * EXCLUDE (n), string_split(replace(replace({_PLAIN_QUOTES}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM c),
f AS (SELECT * EXCLUDE (ls), [CASE WHEN regexp_matches(x, '^\s*(?:[-=*_#~]{{3,}}|#{{1,6}}\s*.*|```.*)\s*$') AND NOT regexp_matches(x, '[\x{{1780}}-\x{{17FF}}]') THEN NULL ELSE x END for x in ls] AS ls FROM l),
m AS (SELECT * EXCLUDE (ls), len([1 for x in ls if x IS NULL])::INT AS format_lines, list_sum([{_COUNTS} for raw in ls if raw IS NOT NULL])::INT AS markdown, array_to_string([coalesce({_L}, '') for raw in ls], chr(10)) AS n FROM f)
SELECT doc_id, zwsp, nbsp, control, format_lines, coalesce(markdown, 0) AS markdown, md5({_TRIM(_JOINED)}) AS clean_md5 FROM m
"""


# -- the expressive layer --

FAMILIES = "SELECT * FROM (VALUES " + ", ".join(f"({_LIT(f)}, {[r[0] for r in X.EMOTIONS if r[-1] == f]})" for f in dict.fromkeys(r[-1] for r in X.EMOTIONS)) + ") v(family, emotions)"
_STRESS_N = len(X.STRESS_WORDS)
EMPHASES = f"""
WITH x AS (SELECT DISTINCT l_orderkey % {_STRESS_N} AS i, l_linenumber AS n FROM lineitem)
SELECT i, n, [w for w in [{_words(X.STRESS_WORDS, 'i::INT')}, CASE WHEN n % 2 = 0 THEN {_words(X.STRESS_WORDS, f'((i + 7) % {_STRESS_N})::INT')} || 'xyz' END, {_LIT(X.NAMES[0])}, {_words(X.STRESS_WORDS, f'((i + 3) % {_STRESS_N})::INT')}] if w IS NOT NULL][:3] AS words FROM x
"""
_OF = lambda t: "CASE style " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items()) + " END"
SENTENCE_EMOTIONS = UNITS + f""",
s AS (SELECT *, max(pos) OVER (PARTITION BY doc_id) + 1 AS n, right(text, 3) AS tail FROM units, (VALUES ('news'), ('cinematic'), ('natural')) v(style)),
k AS (SELECT *, CASE WHEN pos % 5 = 1 THEN 'turn' WHEN pos % 7 = 2 THEN 'result' END AS kind, pos / greatest(1, n - 1)::DOUBLE AS place FROM s)
SELECT doc_id, pos, style, CASE WHEN kind = 'turn' THEN {_OF(X.TURN_EMOTION)} WHEN kind = 'result' THEN CASE WHEN style = 'news' THEN 'conclusive' ELSE {_OF(X.STYLE_EMOTION)} END
  WHEN contains(tail, '?') THEN CASE WHEN style = 'natural' THEN 'curious' ELSE 'worried' END WHEN contains(tail, '!') THEN CASE WHEN style = 'news' THEN 'urgent' ELSE 'surprised' END
  WHEN style = 'cinematic' AND regexp_matches(text, '{X.DENIALS}') THEN 'regretful' {' '.join(f"WHEN regexp_matches(text, '{c}') THEN CASE WHEN style = 'cinematic' THEN '{b}' ELSE '{a}' END" for c, a, b in X.SENTENCE_CUES)}
  WHEN length(text) <= 24 AND place > 0.9 AND style = 'news' THEN 'conclusive' ELSE {_OF(X.STYLE_EMOTION)} END AS emotion FROM k
"""
_CUE = "|".join(w.replace("'", "''") for ws in X.CUES.values() for w in ws)
STRESSED = UNITS + rf""",
rx AS (SELECT doc_id, pos, text, '(?is)^(.*?)({_CUE})(.*)$' AS rx FROM units),
found AS (SELECT doc_id, pos, regexp_extract(text, rx, 1) AS a, regexp_extract(text, rx, 2) AS cue, regexp_extract(text, rx, 3) AS z FROM rx),
ph AS (SELECT *, CASE WHEN strpos(a, ' ') = 0 THEN 0 ELSE length(a) - strpos(reverse(a), ' ') END AS start, CASE WHEN regexp_matches(z, '[,។.!?…]') THEN regexp_extract(z, '(?s)^(.*?)[,។.!?…]', 1) ELSE z[:42] END AS tail FROM found)
SELECT doc_id, pos, CASE WHEN cue = '' THEN '' ELSE regexp_replace(a[start + 1:] || cue || tail, '^[ ,]+|[ ,]+$', '', 'g')[:42] END AS stress FROM ph
"""

# units of one supplier, in order: emotion, intensity and air stand in; a step by step nudge, then windows
_LO, _HI = next((s[1], s[2]) for s in X.STYLES if s[0] == "storytelling")
_BAND = _HI - _LO
GUARDED_UNITS = f"""
WITH RECURSIVE b AS (
  SELECT l_suppkey AS key, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1)::INT AS index, CASE WHEN l_suppkey % 7 = 0 THEN 'A' ELSE l_returnflag END AS emotion,
    ({_LO} + CASE WHEN l_suppkey % 5 = 0 THEN 20 ELSE l_quantity * {_BAND} / 60 END)::INT AS intensity, l_discount * 4.5 AS breath FROM lineitem),
r AS (
  SELECT key, index, emotion, intensity FROM b WHERE index = 0
  UNION ALL
  SELECT b.key, b.index, b.emotion, CASE WHEN r.emotion = b.emotion AND abs(r.intensity - b.intensity) < 3 THEN greatest({_LO}, least({_HI}, b.intensity + CASE WHEN b.index % 2 = 1 THEN 4 ELSE -4 END)) ELSE b.intensity END
  FROM r JOIN b ON b.key = r.key AND b.index = r.index + 1),
n AS (SELECT r.*, least(b.breath, 0.30::DOUBLE) AS breath, count(*) OVER w AS n, max(r.intensity) OVER w - min(r.intensity) OVER w AS spread FROM r JOIN b USING (key, index) WINDOW w AS (PARTITION BY r.key)),
f AS (SELECT * REPLACE (CASE WHEN n >= 3 AND spread < {max(6, 0.18 * _BAND)} AND index = n // 2 THEN {int(_HI - 0.12 * _BAND)} WHEN n >= 3 AND spread < {max(6, 0.18 * _BAND)} AND index = 0 THEN {int(_LO + 0.18 * _BAND)} ELSE intensity END AS intensity) FROM n),
h AS (SELECT *, intensity >= {_LO + 0.75 * _BAND} AS hot, count(*) FILTER (intensity >= {_LO + 0.75 * _BAND}) OVER (PARTITION BY key ORDER BY index) AS rank, count(*) FILTER (intensity >= {_LO + 0.75 * _BAND}) OVER (PARTITION BY key) AS hots,
  index - coalesce(max(index) FILTER (breath < 0.28) OVER (PARTITION BY key ORDER BY index), -1) AS airy, count(DISTINCT emotion) OVER (PARTITION BY key) AS kinds FROM f)
SELECT key, index, CASE WHEN n >= 5 AND kinds = 1 AND index = n - 1 THEN 'conclusive' WHEN n >= 5 AND kinds = 1 AND index = n // 2 THEN 'thoughtful' ELSE emotion END AS emotion,
  CASE WHEN n >= 4 AND hot AND hots > greatest(1, floor(n * 0.25)) AND rank > greatest(1, floor(n * 0.25)) THEN {int(_LO + 0.55 * _BAND)} ELSE intensity END::INT AS intensity,
  CASE WHEN airy > 2 THEN least(breath, 0.20::DOUBLE) ELSE breath END AS breath FROM h
"""

SENTENCE_CLAUSES = UNITS + rf""",
zq AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN regexp_replace(text, ', ([^ ,]+) ', ', “\1” ', 'g') ELSE text END AS text FROM units),
za AS (SELECT *, regexp_extract_all(text, '[^,;៖]*[,;៖]\s*') AS parts, regexp_extract_all(text, '.*?[“"''].+?[”"'']') AS said FROM zq),
zc AS (SELECT doc_id, pos, text, k, length(array_to_string(parts[1:k], '')) AS a, CASE WHEN k < len(parts) THEN length(array_to_string(parts[1:k + 1], '')) ELSE length(text) END AS b FROM za, range(0, len(parts) + 1) AS r(k)),
zp AS (SELECT *, text[a + 1:b] AS raw FROM zc WHERE b > a),
zt AS (SELECT doc_id, pos, k, {_TRIM('raw')} AS clause, a + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS a FROM zp),
zs AS (SELECT doc_id, pos, length(array_to_string(said[1:i - 1], '')) + length(regexp_extract(said[i], '^[^“"'']*')) AS qa, length(array_to_string(said[1:i], '')) AS qb FROM za, range(1, len(said) + 1) AS r(i)),
zd AS (SELECT zt.*, EXISTS (SELECT 1 FROM zs WHERE zs.doc_id = zt.doc_id AND zs.pos = zt.pos AND qa <= zt.a + length(clause) AND qb >= zt.a) AS spoken FROM zt WHERE clause <> '')
SELECT doc_id, pos, (row_number() OVER (PARTITION BY doc_id, pos ORDER BY k) - 1)::INT AS no, clause, CASE WHEN spoken THEN 'warm' ELSE 'calm' END AS emotion, spoken AS dialogue FROM zd
"""
