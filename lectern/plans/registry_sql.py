"""Common table expressions that the SQL of several queries shares."""

from __future__ import annotations

from lectern.operators import vocab

ACRONYM_ROWS = "SELECT * FROM (VALUES " + ", ".join(map(str, vocab.ACRONYMS)) + ") v(key, expansion, category)"
DOCS = r"""d AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^\x{FEFF}', ''), '\r\n?', chr(10), 'g') AS text, lang, source FROM documents),
dt AS (SELECT *, CASE WHEN trim(regexp_extract(text, '([^\n]*[^\s][^\n]*)', 1)) = '' THEN 'Untitled document' ELSE substring(trim(regexp_extract(text, '([^\n]*[^\s][^\n]*)', 1)), 1, 80) END AS title FROM d)"""
BLOCKS = DOCS + r""",
bl AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS k FROM d),
b AS (SELECT doc_id, unnest(range(len(k)))::INTEGER AS block, unnest(k) AS line FROM bl),
bw AS (SELECT *, list_filter(string_split(line, ' '), lambda x: x <> '') AS words FROM b),
tk AS (SELECT doc_id, block, unnest(range(len(words)))::INTEGER AS "at", unnest(words) AS word FROM bw)"""
CORE = "regexp_extract(word, '^[^A-Za-z0-9]*(.*?)[^A-Za-z0-9]*$', 1)"
KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '&', ' and ', 'g'), '[‐-―-]+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\bthe\b', ' ', 'g'), ' +', ' ', 'g'))"
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(list_filter(string_split({0}, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
ANSWERS = """a AS (SELECT event_id, ts, user_id AS reader, (props->>'$.k')::INTEGER % 7 AS item,
  CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS quality FROM events WHERE event_type IN ('error', 'view', 'click', 'purchase') AND (props->>'$.k') IS NOT NULL)"""
PAPERS = ANSWERS + """,
pa AS (SELECT *, ts::DATE AS day, reader || '-' || strftime(ts, '%Y%m%d') AS paper, ['cloze', 'grid', 'acronym'][item % 3 + 1] AS kind, quality >= 2 AS correct FROM a),
pp AS (SELECT reader, paper, day, floor(count(*) FILTER (correct) * 100 / count(*) + 0.5)::BIGINT AS percent FROM pa GROUP BY ALL)"""
STATE = ANSWERS.replace("a AS", "RECURSIVE a AS", 1) + """,
o AS (SELECT *, row_number() OVER (PARTITION BY reader, item ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY reader, item) AS n FROM a),
f AS (SELECT reader, item, 0::BIGINT AS i, 2.5::DOUBLE AS ease, 0 AS days, 0 AS reps, 0 AS lapses, NULL::TIMESTAMP AS last FROM o WHERE i = 1
  UNION ALL SELECT o.reader, o.item, o.i, least(2.8, greatest(1.3, f.ease + [-0.8, -0.15, 0.0, 0.15][o.quality + 1]))::DOUBLE,
  (CASE WHEN o.quality = 0 THEN 0 ELSE least(180, CASE WHEN f.reps = 0 THEN CASE WHEN o.quality = 3 THEN 3 ELSE 1 END WHEN f.reps = 1 THEN CASE WHEN o.quality = 1 THEN 3 ELSE 6 END
    ELSE greatest(1, floor(f.days * least(2.8, greatest(1.3, f.ease + [-0.8, -0.15, 0.0, 0.15][o.quality + 1]))::DOUBLE + 0.5)::INTEGER) END) END)::INTEGER,
  CASE WHEN o.quality = 0 THEN 0 ELSE f.reps + 1 END, f.lapses + CASE WHEN o.quality = 0 THEN 1 ELSE 0 END, o.ts FROM f JOIN o ON o.reader = f.reader AND o.item = f.item AND o.i = f.i + 1),
st AS (SELECT f.reader, f.item, round(ease, 6) AS ease, days, reps, lapses, o.n AS answers, last, CASE WHEN days = 0 THEN last + INTERVAL 10 MINUTE ELSE last + to_days(days) END AS due FROM f JOIN o ON o.reader = f.reader AND o.item = f.item AND o.i = f.i AND o.i = o.n),
df AS (SELECT reader, item, round(greatest(least(1.0, lapses / 3.0), greatest(0.0, least(1.0, (2.5 - ease) / 1.2))), 6)::DOUBLE AS weight FROM st)"""
PACE = """p AS (SELECT event_id, ts, user_id AS voice, (10 + (props->>'$.k')::INTEGER % 5) AS tenths, floor(value)::BIGINT AS words, (floor(value) * (360 - 20 * ((props->>'$.k')::INTEGER % 5)))::BIGINT AS ms FROM events),
pt AS (SELECT voice, tenths, sum(words)::BIGINT AS words, sum(ms)::BIGINT AS ms FROM p GROUP BY ALL),
pf0 AS (SELECT voice, count(*) AS points, regr_slope(words / (ms / 60000.0::DOUBLE), tenths / 10.0::DOUBLE) AS s, regr_intercept(words / (ms / 60000.0::DOUBLE), tenths / 10.0::DOUBLE) AS i,
  avg(words / (ms / 60000.0::DOUBLE)) AS w, avg(tenths / 10.0::DOUBLE) AS r FROM pt WHERE words >= 40 AND ms >= 8000 GROUP BY voice),
pf AS (SELECT voice, points, round(CASE WHEN points > 1 AND s > 0 THEN s ELSE w / r END, 6) AS slope, round(CASE WHEN points > 1 AND s > 0 THEN i ELSE 0.0 END, 6) AS intercept FROM pf0)"""
TOPICS = BLOCKS + f""",
rq0 AS (SELECT item_id, trim(string_split(coalesce(text, ''), chr(10))[1]) AS title FROM benchmark),
rq AS (SELECT {KEY.format("title")} AS topic, min_by(title, item_id) AS title, count(DISTINCT item_id % 6) AS groups FROM rq0 WHERE {KEY.format("title")} <> '' GROUP BY 1),
un AS (SELECT doc_id, block, {KEY.format("line")} AS topic, len(string_split(line, ' '))::INTEGER AS words FROM b)"""
MERGE = """l AS (SELECT c_custkey, c_name, c_acctbal AS updated FROM customer WHERE c_custkey % 5 <> 0),
k AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal + (c_custkey % 7 - 3) AS updated FROM customer WHERE c_custkey % 3 <> 0),
m AS (SELECT coalesce(l.c_custkey, k.c_custkey) AS c_custkey, CASE WHEN l.c_custkey IS NULL OR k.updated > l.updated THEN k.c_name ELSE l.c_name END AS c_name, CASE WHEN l.c_custkey IS NULL OR k.updated > l.updated THEN k.updated ELSE l.updated END AS updated,
  CASE WHEN l.c_custkey IS NULL THEN 'added' WHEN k.updated > l.updated THEN 'updated' ELSE 'kept' END AS action FROM l FULL JOIN k ON l.c_custkey = k.c_custkey)"""
CATALOG = DOCS + r", ct AS (SELECT doc_id, title, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INTEGER AS n_words FROM dt)"
