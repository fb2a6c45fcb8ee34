"""SQL for the queries of ``study``, as DuckDB runs it on the given tables."""

from __future__ import annotations

from functools import reduce

from lectern.operators import coverage, entities, papers, structure, text, vocab
from lectern.operators.questions import STOPWORDS
from lectern.plans.registry_sql import ACRONYM_ROWS, CORE, DOCS, FNV, KEY, PAPERS, STATE
from lectern.plans.registry_sql import BLOCKS as LINE_BLOCKS
from lectern.sources import tables


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _slug(x: str) -> str:
    return f"substring(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 48)"


SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
PAGES = f"pg AS (SELECT page_id AS doc_id, {reduce(lambda x, m: f'regexp_replace({x}, {_q(m[0])}, {_q(m[1])}, {_q("g")})', tables.MARKUP, "coalesce(html, '')")} AS text FROM pages)"


def _blocks(source: str, p: str) -> str:
    """Blocks of ``source(doc_id, text)`` as ``{p}bk``; names start with ``p``."""
    kinds = " ".join(f"WHEN regexp_matches(line, {_q(x)}) THEN '{k}'" for k, x in structure.KINDS)
    return f"""{p}ln AS (SELECT doc_id, unnest(range(len(l)))::INTEGER AS "at", unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {source})),
{p}k0 AS (SELECT *, CASE WHEN {SQUEEZE.format("line")} = '' THEN 'blank' {kinds} ELSE 'p' END AS kind FROM {p}ln),
{p}kd AS (SELECT doc_id, "at", kind, CASE WHEN kind = 'li' AND regexp_extract(line, '^\\s*(\\d+)[.)]', 1) <> '' THEN regexp_extract(line, '^\\s*(\\d+)[.)]', 1)::INTEGER END AS ordinal,
  {SQUEEZE.format(f"CASE WHEN kind = 'p' THEN line ELSE regexp_replace(line, {_q(structure.MARKS)}, '') END")} AS body FROM {p}k0),
{p}k1 AS (SELECT *, CASE WHEN kind = 'p' AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY "at"), '') = 'p' THEN 0 ELSE 1 END AS new FROM {p}kd),
{p}k2 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS island FROM {p}k1),
{p}k3 AS (SELECT doc_id, island, any_value(kind) AS kind, string_agg(body, ' ' ORDER BY "at") AS text FROM {p}k2 WHERE kind <> 'blank' GROUP BY 1, 2),
{p}k4 AS (SELECT *, len(list_filter(string_split(text, ' '), lambda x: x <> ''))::INTEGER AS words, (row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1)::INTEGER AS block FROM {p}k3),
{p}bk AS (SELECT doc_id, block, kind, text, words, coalesce(sum(words) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM {p}k4)"""


def _sections(p: str) -> str:
    return f"""{p}h0 AS (SELECT *, kind IN ('h1', 'h2', 'h3') AS hd, first_value(kind IN ('h1', 'h2', 'h3')) OVER (PARTITION BY doc_id ORDER BY block) AS hf FROM {p}bk),
{p}pl AS (SELECT doc_id, block, kind, words, start, (sum(hd::INTEGER) OVER w - hf::INTEGER)::BIGINT AS seed, coalesce(last_value(CASE WHEN hd THEN text END IGNORE NULLS) OVER w, 'Opening') AS title,
  coalesce(last_value(CASE WHEN hd THEN substring(kind, 2, 1)::INTEGER END IGNORE NULLS) OVER w, 0) AS level FROM {p}h0 WINDOW w AS (PARTITION BY doc_id ORDER BY block ROWS UNBOUNDED PRECEDING)),
{p}sr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seed ORDER BY block) AS r FROM {p}pl),
{p}pr AS (SELECT *, words AS acc, 0 AS k FROM {p}sr WHERE r = 1 UNION ALL
  SELECT b.*, CASE WHEN a.acc >= {text.STRETCH_WORDS} THEN 0 ELSE a.acc END + b.words, a.k + (a.acc >= {text.STRETCH_WORDS})::INTEGER FROM {p}pr a JOIN {p}sr b ON a.doc_id = b.doc_id AND a.seed = b.seed AND b.r = a.r + 1),
{p}s0 AS (SELECT doc_id, seed, k, any_value(title) AS base, any_value(level) AS lv, min(block) AS block_from, max(block) + 1 AS block_to, min(start)::INTEGER AS token_from, sum(words)::INTEGER AS words FROM {p}pr GROUP BY 1, 2, 3),
{p}s1 AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY block_from) - 1)::INTEGER AS section, CASE WHEN k = 0 THEN base ELSE base || ' (part ' || (k + 1) || ')' END AS title,
  CASE WHEN count(*) OVER (PARTITION BY doc_id, seed) > 1 THEN (k + 1)::INTEGER END AS part, CASE WHEN k = 0 THEN lv ELSE 2 END AS level FROM {p}s0),
{p}s2 AS (SELECT *, max(section) FILTER (section < {structure.CONTENTS_WITHIN} AND regexp_matches(title, {_q(structure.CONTENTS)})) OVER (PARTITION BY doc_id) AS cn FROM {p}s1),
{p}s3 AS (SELECT *, section <= coalesce(cn, -1) OR regexp_matches(title, {_q(structure.TRAILING)}) OR (section < {structure.AUTHORS_WITHIN} AND (regexp_matches(title, {_q(structure.CITED)}) OR regexp_matches(title, {_q(structure.RUN_ON)}))) AS furniture FROM {p}s2),
{p}sx AS (SELECT doc_id, section, title, base, part, level, block_from, block_to, token_from, (token_from + words)::INTEGER AS token_to, words, furniture, level IN (1, 2) AND words >= {text.STOP_WORDS} AND NOT furniture AS intercept FROM {p}s3),
{p}s4 AS (SELECT *, first_value(CASE WHEN NOT furniture THEN intercept END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS en FROM {p}sx),
{p}ow AS (SELECT * EXCLUDE (en), NOT furniture AND words >= {text.STOP_WORDS} AND coalesce(en, false) AS owes FROM {p}s4)"""


def _last(mark: str) -> str:
    m = mark[::-1]
    return f"CASE WHEN strpos(reverse(substring(rest, 1, {structure.LONGEST})), '{m}') > 0 THEN length(substring(rest, 1, {structure.LONGEST})) - strpos(reverse(substring(rest, 1, {structure.LONGEST})), '{m}') + 1 - {len(mark)} ELSE -1 END"


def _sentences(p: str) -> str:
    return f"""{p}q0 AS (SELECT doc_id, block, kind, string_split(regexp_replace(text, {_q(text.SENTENCE)}, '\\1' || chr(31) || '\\2', 'g'), chr(31)) AS p FROM {p}bk),
{p}q1 AS (SELECT doc_id, block, kind, unnest(p) AS piece, unnest(range(len(p))) AS i FROM {p}q0),
{p}q2 AS (SELECT *, CASE WHEN coalesce(regexp_matches(lag(piece) OVER (PARTITION BY doc_id, block ORDER BY i), {_q(text.OPEN_END)}), false) THEN 0 ELSE 1 END AS new FROM {p}q1),
{p}q3 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, block ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM {p}q2),
{p}q4 AS (SELECT doc_id, block, any_value(kind) AS kind, s, string_agg(piece, ' ' ORDER BY i) AS sentence FROM {p}q3 GROUP BY doc_id, block, s)"""


def _chunks(p: str) -> str:
    stop = "greatest(" + ", ".join(_last(m) for m in ("; ", ", ", " — ", " – ")) + ")"
    cut = f"CASE WHEN {stop} > {structure.LONGEST * structure.CUT_SHARE} THEN {stop} + 1 WHEN {_last(' ')} > 0 THEN {_last(' ')} ELSE {structure.LONGEST} END"
    return f"""{_sentences(p)},
{p}q5 AS (SELECT doc_id, block, kind, s, 0 AS part, CASE WHEN length(sentence) > {structure.LONGEST} THEN '' ELSE sentence END AS piece, CASE WHEN length(sentence) > {structure.LONGEST} THEN sentence ELSE '' END AS rest FROM {p}q4
  UNION ALL SELECT doc_id, block, kind, s, part + 1, CASE WHEN length(rest) > {structure.LONGEST} THEN trim(substring(rest, 1, ({cut})::BIGINT)) ELSE trim(rest) END,
    CASE WHEN length(rest) > {structure.LONGEST} THEN trim(substring(rest, ({cut})::BIGINT + 1)) ELSE '' END FROM {p}q5 WHERE rest <> ''),
{p}q6 AS (SELECT *, len(list_filter(string_split(piece, ' '), lambda x: x <> ''))::INTEGER AS n FROM {p}q5 WHERE piece <> ''),
{p}ch AS (SELECT doc_id, (row_number() OVER w - 1)::INTEGER AS chunk, block, kind, piece AS text, n, (sum(n) OVER w - n)::BIGINT AS start, (sum(n) OVER w)::BIGINT AS stop FROM {p}q6
  WINDOW w AS (PARTITION BY doc_id ORDER BY block, s, part ROWS UNBOUNDED PRECEDING))"""


def _tokens(p: str) -> str:
    return f"""{p}t0 AS (SELECT doc_id, chunk, block, kind, start, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM {p}ch),
{p}t1 AS (SELECT doc_id, chunk, block, kind, start, unnest(w) AS word, unnest(range(len(w))) AS "at" FROM {p}t0),
{p}tk AS (SELECT doc_id, (start + "at")::BIGINT AS i, chunk, block, kind, "at", word, {CORE} AS core FROM {p}t1),
fm AS (SELECT key AS acronym, expansion, category, unnest([key, key || 's', key || '''s', key || '’s']) AS form FROM ({ACRONYM_ROWS})),
{p}tg AS (SELECT t.*, f.acronym FROM {p}tk t LEFT JOIN fm f ON t.core = f.form),
{p}s8 AS (SELECT *, CASE WHEN acronym IS NOT NULL THEN {papers.ACRONYM_SCORE} WHEN contains(word, '[') THEN 0 WHEN regexp_matches(core, '[0-9]') AND length(core) >= 2 THEN {papers.NUMBER_SCORE}
  WHEN "at" = 0 OR lower(core) IN {STOPWORDS} THEN 0 WHEN regexp_full_match(core, '[A-Z]{{2,}}') THEN {papers.CAPITALS_SCORE} WHEN regexp_full_match(core, '[A-Z][a-z]{{3,}}') THEN {papers.NAME_SCORE} ELSE 0 END AS score FROM {p}tg
  WHERE core <> '' AND kind NOT IN {papers.NOT_ASKED}),
{p}sl AS (SELECT *, coalesce(acronym, {_slug("core")}) AS key FROM {p}s8 WHERE score > 0)"""


BLOCKS = f"{PAGES}, {_blocks('pg', 'p')}"
SECTIONS = f"{BLOCKS}, {_sections('p')}"
HEARD = f"""{SECTIONS}, {_chunks("p")}, hr AS (SELECT c.*, s.section, s.furniture FROM pch c JOIN psx s ON c.doc_id = s.doc_id AND c.block >= s.block_from AND c.block < s.block_to)"""
DOC_BLOCKS = f"{DOCS}, {_blocks('d', 'd')}"
DOC_CHUNKS = f"{DOC_BLOCKS}, {_chunks('d')}"

#: Sentences in which the words "of" and "the" (or a form of it) follow each other, and how often.
SITES = f"""{LINE_BLOCKS}, dbk AS (SELECT doc_id, block, 'p' AS kind, line AS text FROM b), {_sentences("d")},
hw AS (SELECT doc_id, block, s, sentence, list_transform(list_filter(string_split(sentence, ' '), lambda x: x <> ''), lambda word: lower({CORE})) AS c FROM dq4),
hp AS (SELECT doc_id, block, s, sentence, len(list_filter(range(1, len(c)), lambda i: c[i] = 'of' AND c[i + 1] IN ('the', 'thes', 'thees')))::INTEGER AS hits FROM hw), h AS (SELECT * FROM hp WHERE hits > 0)"""

LINES = f"""{LINE_BLOCKS}, dbk AS (SELECT doc_id, block, 'p' AS kind, line AS text, len(words)::INTEGER AS words, coalesce(sum(len(words)) OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM bw)"""

READING = """rd AS (SELECT event_id, ts, user_id AS reader, event_type, (props->>'$.k')::BIGINT AS doc_id, floor(value * 2)::INTEGER AS caret FROM events WHERE (props->>'$.k') IS NOT NULL),
se AS (SELECT reader, doc_id, max(caret) AS caret, (floor(max(caret) / 250) * 250)::INTEGER AS checked FROM rd GROUP BY 1, 2),
wn AS (SELECT reader, doc_id, (w - 250)::INTEGER AS "from", w AS "to", 3 AS blanks, (arg_max(event_id, (ts, event_id)) % 4)::INTEGER AS recalled FROM (SELECT *, (floor(caret / 250) * 250 + 250)::INTEGER AS w FROM rd WHERE event_type = 'click') GROUP BY reader, doc_id, w),
su AS (SELECT DISTINCT reader, doc_id, (event_id % 4)::INTEGER AS section FROM rd WHERE event_type = 'purchase')"""


def _share(caret: str, a: str, b: str) -> str:
    return f"CASE WHEN {b} <= {a} THEN CASE WHEN {caret} + 1 >= {b} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({caret} + 1 - {a})::DOUBLE / ({b} - {a}))) END"


COVERED = f"""{SECTIONS}, {READING},
cs AS (SELECT w.reader, w.doc_id, s.section, count(*) AS windows, sum(w.blanks)::BIGINT AS blanks, sum(w.recalled)::BIGINT AS recalled FROM wn w JOIN psx s ON w.doc_id = s.doc_id AND w."to" > s.token_from AND w."from" < s.token_to AND s.token_to > s.token_from GROUP BY ALL),
c0 AS (SELECT e.reader, e.doc_id, e.caret, o.*EXCLUDE (doc_id), cs.windows, cs.blanks, cs.recalled, u.section IS NOT NULL AS given FROM se e JOIN pow o USING (doc_id) LEFT JOIN cs ON cs.reader = e.reader AND cs.doc_id = e.doc_id AND cs.section = o.section
  LEFT JOIN su u ON u.reader = e.reader AND u.doc_id = e.doc_id AND u.section = o.section),
c1 AS (SELECT *, {_share("caret", "token_from", "token_to")} AS rs, CASE WHEN NOT owes THEN 'n/a' WHEN given THEN 'done' ELSE 'owed' END AS summary FROM c0),
c2 AS (SELECT *, (coalesce(windows, 0) > 0)::INTEGER + (summary = 'done')::INTEGER AS dn, 1 + (summary <> 'n/a')::INTEGER AS du FROM c1),
cv AS (SELECT reader, doc_id, section, base AS title, CASE WHEN furniture THEN 0 ELSE words END AS words, round(rs, 6) AS read, summary, coalesce(windows, 0)::BIGINT AS windows, coalesce(blanks, 0)::BIGINT AS blanks, coalesce(recalled, 0)::BIGINT AS recalled,
  CASE WHEN furniture THEN 'verified' WHEN rs < 1 THEN 'unread' WHEN dn = 0 THEN 'unchecked' WHEN dn = du THEN 'verified' ELSE 'partial' END AS state, CASE WHEN blanks > 0 THEN round(recalled::DOUBLE / blanks, 6) END AS recall FROM c2)"""
UNITS = f"""{COVERED}, u0 AS (SELECT reader, doc_id, section, title, words::BIGINT AS words, floor(words * read + 0.5)::BIGINT AS read_words, CASE WHEN state = 'verified' THEN words ELSE 0 END::BIGINT AS verified_words FROM cv WHERE words > 0),
ti AS (SELECT doc_id, min_by(base, section) AS title FROM psx WHERE level = 1 GROUP BY 1),
ut AS (SELECT * FROM u0 UNION ALL SELECT reader, doc_id, NULL, ti.title, sum(words)::BIGINT, sum(read_words)::BIGINT, sum(verified_words)::BIGINT FROM u0 JOIN ti USING (doc_id) GROUP BY reader, doc_id, ti.title)"""
TOPICS = f"""{UNITS}, tp AS (SELECT {KEY.format("base")} AS topic, list_sort(list_distinct(list(doc_id % 10))) AS groups FROM psx WHERE level > 0 AND coalesce(part, 1) = 1 AND {KEY.format("base")} <> '' GROUP BY 1),
x0 AS (SELECT ut.*, tp.topic FROM ut JOIN tp ON {KEY.format("ut.title")} = tp.topic),
x1 AS (SELECT *, bool_or(section IS NOT NULL AND words >= {text.STOP_WORDS}) OVER w AS lg, bool_or(section IS NULL) OVER w AS wh FROM x0 WINDOW w AS (PARTITION BY reader, doc_id, topic)),
ex AS (SELECT * EXCLUDE (lg, wh) FROM x1 WHERE CASE WHEN section IS NULL THEN NOT lg ELSE lg OR NOT wh END),
sm AS (SELECT topic, sum(words)::BIGINT AS words, sum(read_words)::BIGINT AS read_words, sum(verified_words)::BIGINT AS verified_words FROM ex GROUP BY 1),
tc AS (SELECT topic, groups, coalesce(words, 0)::BIGINT AS words, coalesce(read_words, 0)::BIGINT AS read_words, coalesce(verified_words, 0)::BIGINT AS verified_words,
  CASE WHEN coalesce(words, 0) = 0 THEN 'absent' WHEN read_words = 0 THEN 'unread' WHEN verified_words >= words THEN 'verified' WHEN verified_words > 0 THEN 'partial' ELSE 'unchecked' END AS state FROM tp LEFT JOIN sm USING (topic))"""

#: The state CTE names its own recursion; here all queries are recursive.
WEAK = f"""{STATE.removeprefix("RECURSIVE ")}, wk AS (SELECT item, max(weight) AS weight FROM df GROUP BY 1 HAVING max(weight) > 0)"""
TOKENS = f"{DOC_CHUNKS}, {_tokens('d')}"
CANDIDATES = f"""{TOKENS}, {WEAK}, lg AS (SELECT doc_id, max(stop) AS n_words FROM dch GROUP BY 1),
ca0 AS (SELECT doc_id, (i // 250)::BIGINT AS win, key, sum(score)::BIGINT AS own, count(*) AS times, min(i) AS first FROM dsl JOIN lg USING (doc_id) WHERE (i // 250 + 1) * 250 <= n_words GROUP BY ALL),
ca AS (SELECT doc_id, win, key, round(own + {papers.WEAK_BOOST} * coalesce(wk.weight, 0.0), 6)::DOUBLE AS score, times, first FROM (SELECT *, ({FNV.format("key")}) % 7 AS it FROM ca0) c LEFT JOIN wk ON wk.item = c.it)"""
CARRIERS = f"""cr0 AS (SELECT s.doc_id, s.i, s.chunk, s.key, s.core, s.acronym, c.text, CASE WHEN s."at" = 0 THEN 0 ELSE length(array_to_string(string_split(c.text, ' ')[1:s."at"], ' ')) + 1 END + length(regexp_extract(s.word, '^([^A-Za-z0-9]*)', 1)) AS ld
  FROM dsl s JOIN dch c USING (doc_id, chunk) WHERE c.n >= {papers.CARRIER_WORDS}),
cr1 AS (SELECT *, substring(text, 1, ld) AS head, substring(text, 1, ld) || '{papers.BLANK}' || substring(text, ld + length(core) + 1) AS carrier FROM cr0),
cr AS (SELECT doc_id, i, chunk, key, core AS answer, acronym, carrier FROM cr1 WHERE NOT contains(carrier, core) AND NOT (regexp_full_match(core, '[0-9][0-9.–-]*') AND regexp_matches(head, {_q(papers.REFERENCE)})))"""
CHECKS = f"""{CANDIDATES}, {CARRIERS},
pk0 AS (SELECT c.doc_id, c.win, c.key, c.score, c.first, list((r.i, r.chunk, r.answer, r.acronym, r.carrier) ORDER BY r.i) AS places FROM ca c JOIN cr r ON r.doc_id = c.doc_id AND r.i // 250 = c.win AND r.key = c.key GROUP BY ALL),
pk1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, win ORDER BY score DESC, first, key) AS r FROM pk0),
pk AS (SELECT doc_id, win, 0::BIGINT AS r, []::BIGINT[] AS chunks, []::BIGINT[] AS picks FROM pk1 WHERE r = 1 UNION ALL
  SELECT b.doc_id, b.win, b.r, CASE WHEN ok THEN list_append(chunks, cc) ELSE chunks END, CASE WHEN ok THEN list_append(picks, ii) ELSE picks END FROM (
    SELECT b.doc_id, b.win, b.r, a.chunks, a.picks, list_filter(b.places, lambda p: NOT list_contains(a.chunks, p[2]))[1][2]::BIGINT AS cc, list_filter(b.places, lambda p: NOT list_contains(a.chunks, p[2]))[1][1]::BIGINT AS ii,
      len(a.picks) < {papers.MOST_BLANKS} AND len(list_filter(b.places, lambda p: NOT list_contains(a.chunks, p[2]))) > 0 AS ok FROM pk a JOIN pk1 b ON a.doc_id = b.doc_id AND a.win = b.win AND b.r = a.r + 1) b),
pe AS (SELECT doc_id, win, unnest(arg_max(picks, r)) AS i FROM pk GROUP BY 1, 2 HAVING len(arg_max(picks, r)) >= {papers.LEAST_BLANKS}),
ck AS (SELECT pe.doc_id, pe.win, cr.i, cr.chunk, cr.key, cr.answer, cr.acronym, cr.carrier FROM pe JOIN cr USING (doc_id, i))"""
SEED = "lectern"
CLOZE = f"""{CHECKS}, cq0 AS (SELECT *, lower(coalesce(acronym, answer)) AS m, doc_id || ':cloze:' || i AS id FROM ck QUALIFY row_number() OVER (PARTITION BY doc_id, lower(coalesce(acronym, answer)) ORDER BY i) = 1),
cq1 AS (SELECT *, {FNV.format(f"'{SEED}:cloze' || id")} AS h FROM cq0),
cq AS (SELECT doc_id, id, 'cloze' AS kind, 'cloze:' || m AS meaning, carrier AS prompt, answer, row_number() OVER (PARTITION BY doc_id ORDER BY h, id)::INTEGER AS place FROM cq1 QUALIFY place <= {papers.PER_DOC})"""
ACRONYM = f"""dc AS ({ACRONYM_ROWS}), ot AS (SELECT a.key AS acronym, a.expansion AS answer, a.category = b.category AS same, b.key AS other, b.expansion AS txt FROM dc a JOIN dc b ON a.key <> b.key),
o1 AS (SELECT *, sum(same::INTEGER) OVER (PARTITION BY acronym) AS n FROM ot), o2 AS (SELECT *, {FNV.format(f"'{SEED}' || acronym || other")} AS h FROM o1 WHERE (n < {papers.OPTIONS - 1} OR same) AND txt <> answer),
o3 AS (SELECT * FROM o2 QUALIFY row_number() OVER (PARTITION BY acronym ORDER BY h, other) < {papers.OPTIONS}),
o4 AS (SELECT acronym, answer, unnest(list_prepend(answer, list(txt))) AS t FROM o3 GROUP BY 1, 2 HAVING count(*) = {papers.OPTIONS - 1}),
op AS (SELECT acronym, answer, string_agg(t, '|' ORDER BY h, t) AS options FROM (SELECT *, {FNV.format(f"'{SEED}' || acronym || ':opt' || t")} AS h FROM o4) GROUP BY 1, 2),
us AS (SELECT DISTINCT doc_id, acronym FROM dtg WHERE acronym IS NOT NULL),
aq0 AS (SELECT doc_id, doc_id || ':acronym:' || acronym AS id, acronym, answer, options, {FNV.format(f"'{SEED}:acr' || acronym")} AS h FROM us JOIN op USING (acronym)),
aq AS (SELECT doc_id, id, 'acronym' AS kind, 'acr:' || acronym AS meaning, 'What does ' || acronym || ' stand for?' AS prompt, answer, options, row_number() OVER (PARTITION BY doc_id ORDER BY h, id)::INTEGER AS place FROM aq0)"""
POOL = f"""{CLOZE}, {ACRONYM}, po AS (SELECT doc_id, id, kind, meaning, prompt, answer, place FROM cq UNION ALL SELECT doc_id, id, kind, meaning, prompt, answer, place FROM aq WHERE place <= {papers.PER_DOC})"""
#: Roles of words as letters (E: a name goes on, F: it ends, C: connector, X: neither); names are then what a pattern finds in a document's letters.
MENTIONS = f"""{TOKENS}, {_sections("d")},
lc AS (SELECT t.*, x.section, x.furniture, regexp_extract(word, '^([^A-Za-z0-9]*)(.*?)([^A-Za-z0-9]*)$', 3) AS trail FROM dtg t JOIN dsx x ON t.doc_id = x.doc_id AND t.block >= x.block_from AND t.block < x.block_to),
ro AS (SELECT *, CASE WHEN furniture OR kind = 'code' OR acronym IS NOT NULL THEN 'X' WHEN length(core) > 1 AND strpos(word, '[') = 0 AND regexp_matches(core, '^[A-Z].*[a-z]') AND lower(core) NOT IN {entities.NOT_NAMES}
  THEN CASE WHEN "at" = 0 THEN 'X' WHEN trail = '' THEN 'E' ELSE 'F' END WHEN trail = '' AND regexp_full_match(core, 'of|and|for|the|to|in|on|with|at|an?|de') THEN 'C' ELSE 'X' END AS r FROM lc),
ls AS (SELECT doc_id, regexp_replace(string_agg(r, '' ORDER BY i), '(E(?:C{{0,2}}E)*(?:C{{0,2}}F)?|F)', '<\\1>', 'g') AS m FROM ro GROUP BY 1),
cs0 AS (SELECT doc_id, unnest(string_split(m, '')) AS c, unnest(range(length(m))) AS p FROM ls),
cs1 AS (SELECT doc_id, c, sum((c NOT IN ('<', '>'))::INTEGER) OVER w - 1 AS i, sum((c = '<')::INTEGER) OVER w AS island, sum(CASE c WHEN '<' THEN 1 WHEN '>' THEN -1 ELSE 0 END) OVER w AS inside FROM cs0 WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
nw AS (SELECT o.*, c.island, count(*) FILTER (o.r <> 'C') OVER (PARTITION BY o.doc_id, c.island ORDER BY o.i) + (o.r = 'C')::INTEGER AS k FROM cs1 c JOIN ro o ON o.doc_id = c.doc_id AND o.i = c.i WHERE c.inside = 1 AND c.c NOT IN ('<', '>')),
np AS (SELECT doc_id, island, k, count(*) AS n, list(core ORDER BY i) AS ws, arg_max(i, i) AS i, arg_max(section, i) AS section FROM nw GROUP BY 1, 2, 3),
nr AS (SELECT doc_id, island, k, 0 AS run, n AS l, ws, i, section FROM np WHERE k = 1
  UNION ALL SELECT p.doc_id, p.island, p.k, CASE WHEN a.l + p.n <= 8 THEN a.run ELSE a.run + 1 END, CASE WHEN a.l + p.n <= 8 THEN a.l + p.n ELSE 1 END, CASE WHEN a.l + p.n <= 8 THEN p.ws ELSE p.ws[-1:] END, p.i, p.section FROM nr a JOIN np p ON p.doc_id = a.doc_id AND p.island = a.island AND p.k = a.k + 1),
nm AS (SELECT doc_id, min(i) AS i, arg_min(section, i) AS section, string_agg(array_to_string(ws, ' '), ' ' ORDER BY i) AS display FROM nr GROUP BY doc_id, island, run),
mn AS (SELECT doc_id, i, section, 'term' AS kind, {_slug("display")} AS key, display FROM nm UNION ALL SELECT doc_id, i, section, 'acronym', acronym, acronym FROM lc WHERE acronym IS NOT NULL AND NOT furniture AND kind <> 'code')"""
INDEX = MENTIONS + """,
en0 AS (SELECT doc_id, key, arg_min(display, i) AS display, arg_min(kind, i) AS kind, count(*) AS n, min(i) AS first, list_sort(list_distinct(list(section)))[:12] AS sections FROM mn GROUP BY 1, 2),
lo AS (SELECT doc_id, core, count(*) AS n FROM lc WHERE NOT furniture AND kind <> 'code' AND acronym IS NULL AND regexp_full_match(core, '[a-z]{2,}') GROUP BY 1, 2),
en1 AS (SELECT e.* FROM en0 e LEFT JOIN lo ON lo.doc_id = e.doc_id AND lo.core = lower(e.display) WHERE e.kind = 'acronym' OR (e.n > 1 AND (strpos(e.display, ' ') > 0 OR e.n >= coalesce(lo.n, 0)))),
en AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, display, key)::INTEGER AS rank, key, display, kind, n AS count, first, sections, greatest(count(*) OVER (PARTITION BY doc_id) - 600, 0)::BIGINT AS truncated FROM en1 QUALIFY rank <= 600)"""
LISTED = "string_agg(doc_id || ':' || count || ':' || first || ':' || len(sections), ',' ORDER BY count DESC, doc_id)"


def _corpus(listed: str) -> str:
    return INDEX + f""",
cx AS (SELECT key, arg_max(display, (count, -doc_id)) AS display, arg_min(kind, doc_id) AS kind, count(*) AS docs, sum(count)::BIGINT AS total,
  {listed} AS listed FROM en GROUP BY 1)"""


CORPUS = _corpus(f"CASE WHEN count(*) <= 1000 THEN {LISTED} END")
ANSWER = r"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[’'']s\b', '', 'g'), '[^a-z0-9%. ]+', ' ', 'g'), ' +', ' ', 'g')), 's$', '')"
FORMS = f"""f0 AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(string_split(coalesce(text, ''), chr(10))[1], '\\s+'), lambda word: {CORE}), lambda x: x <> '') AS w FROM benchmark),
f1 AS (SELECT item_id, w, w[-1] AS l FROM f0 WHERE len(w) > 0)"""


def _report(name: str, rows: list[tuple[str, str, int | None]]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS report, '{check}' AS \"check\", v::BIGINT AS value, {'v = ' + str(want) if want is not None else 'v > 0'} AS ok FROM (SELECT count(*) AS v FROM {source})" for check, source, want in rows)


def _perfect(full: bool) -> str:
    caret = "(max(token_to) OVER (PARTITION BY doc_id) - 1)" if full else "-1"
    state = f"CASE WHEN {_share('caret', 'token_from', 'token_to')} < 1 THEN 'unread' " + ("WHEN token_to > 0 AND token_from < en AND token_to > token_from THEN 'verified' ELSE CASE WHEN owes THEN 'partial' ELSE 'unchecked' END END" if full else "ELSE 'unchecked' END")
    return f"(SELECT *, CASE WHEN furniture THEN 'verified' ELSE {state} END AS state FROM (SELECT *, {caret} AS caret, max(token_to) OVER (PARTITION BY doc_id) AS en FROM pow))"


W = "WITH RECURSIVE "
SQL: dict[str, str] = {
    "src_pages": f"WITH {BLOCKS} SELECT * FROM pkd WHERE kind <> 'blank'",
    "snapshot_export": r"SELECT doc_id, source, md5(text) AS digest FROM documents WHERE regexp_matches(coalesce(text, ''), '\S')",
    "block_kinds": f"WITH {BLOCKS} SELECT doc_id, kind, count(*) AS n, sum(length(body))::BIGINT AS chars FROM pkd GROUP BY ALL",
    "paragraph_islands": f"WITH {BLOCKS} SELECT * FROM pbk",
    "section_of_block": f"{W}{SECTIONS} SELECT doc_id, block, seed, title, level FROM ppl",
    "sections": f"{W}{SECTIONS} SELECT * FROM psx",
    "intercept_flag": f"{W}{SECTIONS} SELECT doc_id, section, level, words, intercept FROM psx",
    "demands_summary": f"{W}{SECTIONS} SELECT doc_id, section, owes FROM pow",
    "content_words": f"{W}{SECTIONS} SELECT doc_id, sum(CASE WHEN furniture THEN 0 ELSE words END)::BIGINT AS content_words FROM psx GROUP BY 1",
    "first_content": f"{W}{SECTIONS} SELECT doc_id, coalesce(min(token_from) FILTER (NOT furniture AND words > 0), 0) AS first_token FROM psx GROUP BY 1",
    "fold_checkpoints": f"""{W}{LINES}, {_sections("d")}, g0 AS (SELECT *, CASE WHEN coalesce(part, 1) > 1 AND lag(base) OVER (PARTITION BY doc_id ORDER BY section) = base THEN 0 ELSE 1 END AS new FROM dsx),
g1 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY section ROWS UNBOUNDED PRECEDING) AS run FROM g0) SELECT doc_id, min(section) AS section, any_value(base) AS base, count(*) AS parts, sum(words)::BIGINT AS words, max(token_to) AS token_to FROM g1 GROUP BY doc_id, run""",
    "cap_length": f"{W}{DOC_CHUNKS} SELECT * FROM dch",
    "sentences": f"""WITH {LINE_BLOCKS}, dbk AS (SELECT doc_id, block, 'p' AS kind, line AS text FROM b), {_sentences("d")} SELECT doc_id, block, (row_number() OVER (PARTITION BY doc_id, block ORDER BY s) - 1)::INTEGER AS sentence, sentence AS text FROM dq4""",
    "bionic_split": f"""{W}{DOC_BLOCKS}, w AS (SELECT DISTINCT unnest(list_filter(string_split(line, ' '), lambda x: x <> '')) AS word FROM (SELECT {SQUEEZE.format("unnest(string_split(text, chr(10)))")} AS line FROM d)),
l AS (SELECT word, length(regexp_extract(word, '^([^A-Za-zÀ-ɏ]*)', 1)) AS h, length(regexp_extract(word, '^[^A-Za-zÀ-ɏ]*([A-Za-zÀ-ɏ][A-Za-zÀ-ɏ''’-]*)', 1)) AS n FROM w)
SELECT word, substring(word, 1, CASE WHEN n = 0 THEN length(word) ELSE h + CASE WHEN n <= 3 THEN 1 ELSE greatest(1, floor(n * 0.45::DOUBLE + 0.5)::INTEGER) END END) AS lead FROM l""",
    "entity_mentions": f"{W}{MENTIONS} SELECT doc_id, i::BIGINT AS i, section, kind, key, display FROM mn",
    "entity_doc": f"{W}{INDEX} SELECT doc_id, rank, key, display, kind, count, first::BIGINT AS first, array_to_string(sections, ',') AS sections, truncated FROM en",
    "entity_corpus": f"{W}{_corpus(LISTED)} SELECT * FROM cx",
    "entity_filter": f"{W}{CORPUS} SELECT cx.* FROM cx LEFT JOIN ({ACRONYM_ROWS}) a ON cx.kind = 'acronym' AND a.key = cx.key WHERE docs >= 2 AND (contains(lower(display), 'e') OR coalesce(contains(lower(expansion), 'e'), false))",
    "section_anchors": f"""{W}{INDEX}, an AS (SELECT doc_id, section, acronym AS label, 'acronym' AS kind, -count(*) AS o FROM lc WHERE acronym IS NOT NULL GROUP BY 1, 2, 3
  UNION ALL SELECT doc_id, unnest(sections), display, 'term', rank FROM en WHERE kind = 'term'),
as0 AS (SELECT *, kind = 'acronym' OR row_number() OVER (PARTITION BY doc_id, section, lower(label) ORDER BY kind, o, label) = 1 AS ok FROM an)
SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY kind, o, label)::INTEGER AS place, label, kind FROM as0 WHERE ok QUALIFY place <= 3""",
    "phrase_words": f"WITH {FORMS} SELECT item_id, array_to_string(w, ' ') AS words FROM f1",
    "final_forms": f"""WITH {FORMS}, f2 AS (SELECT item_id, l, length(l) > 3 AND l LIKE '%s' AND l NOT LIKE '%ss' AS p FROM f1)
SELECT item_id, array_to_string(list_sort(list_distinct(list_filter([l, l || 's', l || 'es', CASE WHEN p THEN l[:-2] END, CASE WHEN p AND l LIKE '%es' THEN l[:-3] END], lambda x: x IS NOT NULL))), ' ') AS forms FROM f2""",
    "short_name": r"SELECT c_custkey, trim(regexp_replace(regexp_replace('Google ' || c_mktsegment || ' voice - ' || c_name, '(?i)^(microsoft|google|apple)\s+', ''), '\s*-\s*[^-]+$', '')) AS label FROM customer",
    "coverage_units": f"{W}{UNITS} SELECT * FROM ut",
    "unit_exclusive": f"{W}{TOPICS} SELECT * FROM ex",
    "topic_match": f"{W}{TOPICS} SELECT reader, doc_id, section, topic, words FROM x0",
    "topic_coverage": f"{W}{TOPICS} SELECT * EXCLUDE (groups) FROM tc",
    "topic_gaps": f"{W}{TOPICS} SELECT topic FROM tc WHERE state = 'absent'",
    "pacing_checkpoints": f"{W}{LINES}, {_sections('d')} SELECT doc_id, section, title, part, block_from, block_to, words FROM dsx",
    "group_coverage": f"""{W}{TOPICS}, g AS (SELECT unnest(groups) AS grp, state FROM tc) SELECT grp, count(*) AS topics, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("absent", "unread", "unchecked", "partial", "verified"))} FROM g GROUP BY 1""",
    "cloze_candidates": f"{W}{CANDIDATES} SELECT * FROM ca",
    "cloze_carriers": f"{W}{TOKENS}, {CARRIERS} SELECT * FROM cr",
    "cloze_checks": f"{W}{CHECKS} SELECT * FROM ck",
    "acronym_questions": f"{W}{TOKENS}, {ACRONYM} SELECT * FROM aq WHERE place <= {papers.PER_DOC}",
    "cloze_questions": f"{W}{CLOZE} SELECT * FROM cq",
    "question_pool": f"{W}{POOL} SELECT * FROM po",
    "drill": f"""{W}{TOKENS}, {WEAK}, {ACRONYM}, j AS (SELECT DISTINCT substring(meaning, 5) AS acronym, answer FROM aq), j1 AS (SELECT *, ({FNV.format("acronym")}) % 7 AS it, {FNV.format(f"'{SEED}:drill' || acronym")} AS h FROM j),
j2 AS (SELECT acronym, answer, h, coalesce(weight, 0.0)::DOUBLE AS weight FROM j1 LEFT JOIN wk ON wk.item = j1.it) SELECT row_number() OVER (ORDER BY weight DESC, h, acronym)::INTEGER AS place, acronym, answer, weight FROM j2""",
    "mark_answers": f"""{W}{CHECKS}, ma AS (SELECT ck.*, v.expansion, CASE WHEN ck.i % 2 = 0 THEN coalesce(v.expansion, upper(answer)) ELSE lead(answer) OVER (PARTITION BY doc_id, ck.key ORDER BY ck.i) END AS given FROM ck LEFT JOIN ({ACRONYM_ROWS}) v ON v.key = ck.acronym)
SELECT doc_id, i, given, {ANSWER.format("coalesce(given, '')")} <> '' AND ({ANSWER.format("coalesce(given, '')")} = {ANSWER.format("answer")} OR coalesce({ANSWER.format("given")} = {ANSWER.format("regexp_replace(expansion, '(?i)^the ', '')")}, false)) AS "right" FROM ma""",
    "readiness": f"""WITH {STATE}, {PAPERS[PAPERS.index("pa AS"):]}, q AS (SELECT reader, count(*) FILTER (due <= TIMESTAMP '2024-02-01 00:00:00') AS due, count(*) AS items FROM st GROUP BY 1),
tr AS (SELECT reader, round(avg(percent) FILTER (rank <= 3), 4) AS mean3 FROM (SELECT *, row_number() OVER (PARTITION BY reader ORDER BY day DESC) AS rank FROM pp) GROUP BY 1) SELECT q.reader, 30 AS days_left, due, items, mean3, 15 AS cap_days FROM q LEFT JOIN tr USING (reader)""",
    "read_share": f"WITH {BLOCKS}, {READING}, n AS (SELECT doc_id, sum(words) AS n_words FROM pbk GROUP BY 1) SELECT reader, doc_id, round({_share('caret', '0', 'n_words')}, 6) AS read FROM se JOIN n USING (doc_id)",
    "cloze_by_section": f"{W}{COVERED} SELECT * FROM cs",
    "section_coverage": f"{W}{COVERED} SELECT * FROM cv",
    "doc_coverage": f"""{W}{COVERED}, a1 AS (SELECT reader, doc_id, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("verified", "partial", "unchecked", "unread"))}, sum(CASE WHEN state = 'verified' THEN words ELSE 0 END)::BIGINT AS verified_words, sum(floor(words * read + 0.5))::BIGINT AS read_words, sum(words)::BIGINT AS total_words,
count(*) FILTER (summary = 'owed') AS summaries_owed, count(*) FILTER (summary = 'done') AS summaries_given FROM cv WHERE words > 0 GROUP BY 1, 2), a2 AS (SELECT reader, doc_id, count(*) AS windows, sum(blanks)::BIGINT AS blanks, sum(recalled)::BIGINT AS recalled FROM wn GROUP BY 1, 2)
SELECT a1.*, coalesce(windows, 0) AS windows, coalesce(blanks, 0)::BIGINT AS blanks, coalesce(recalled, 0)::BIGINT AS recalled FROM a1 LEFT JOIN a2 USING (reader, doc_id)""",
    "state_words": f"{W}{COVERED} SELECT reader, state, sum(words)::BIGINT AS words, round(sum(words)::DOUBLE / sum(sum(words)) OVER (PARTITION BY reader), 6) AS share FROM cv GROUP BY 1, 2",
    "next_to_verify": f"""{W}{COVERED} SELECT reader, doc_id, section, state, words FROM cv WHERE words > 0 AND state <> 'verified' QUALIFY row_number() OVER (PARTITION BY reader, doc_id ORDER BY CASE state WHEN 'unchecked' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, words DESC, section) = 1""",
    "next_stop": f"""{W}{SECTIONS}, {READING}, n AS (SELECT doc_id, sum(words) AS n_words FROM pbk GROUP BY 1), b AS (SELECT doc_id, section, token_to, lead(token_from) OVER v AS nx, NOT furniture AND NOT lead(furniture) OVER v AND lead(intercept) OVER v AS stops FROM psx WINDOW v AS (PARTITION BY doc_id ORDER BY section)),
m AS (SELECT doc_id, max(token_to) AS en FROM psx GROUP BY 1), r AS (SELECT se.reader, se.doc_id, min_by(nx, b.section) AS nx FROM se JOIN m USING (doc_id) JOIN b USING (doc_id) LEFT JOIN su ON su.reader = se.reader AND su.doc_id = se.doc_id AND su.section = b.section WHERE stops AND su.section IS NULL AND (caret < b.token_to OR caret >= en) GROUP BY 1, 2)
SELECT se.reader, se.doc_id, CASE WHEN caret < n_words THEN greatest(0, 250 - (caret - checked)) END::INTEGER AS to_check, CASE WHEN nx IS NOT NULL THEN greatest(0, nx - caret) END::INTEGER AS to_summary FROM se JOIN n USING (doc_id) LEFT JOIN r ON r.reader = se.reader AND r.doc_id = se.doc_id""",
    "check_gauge": f"""{W}{HEARD}, {READING}, n AS (SELECT doc_id, sum(words) AS n_words FROM pbk GROUP BY 1), g AS (SELECT reader, se.doc_id, count(*) AS n, count(*) FILTER (stop <= caret) AS k FROM se JOIN n USING (doc_id) JOIN hr USING (doc_id) WHERE caret < n_words AND NOT furniture AND stop > checked AND start < checked + {coverage.CADENCE} GROUP BY 1, 2)
SELECT reader, doc_id, CASE WHEN n > {coverage.GAUGE} THEN floor(k::DOUBLE / n * {coverage.GAUGE} + 0.5)::BIGINT ELSE k END AS done, least(n, {coverage.GAUGE})::BIGINT AS total, n > {coverage.GAUGE} AS scaled FROM g""",
    "active_block": f"WITH {BLOCKS}, {READING} SELECT reader, doc_id, block, (CASE WHEN caret >= start + words THEN start + words WHEN caret < start THEN -1 ELSE caret END)::BIGINT AS active FROM se JOIN pbk USING (doc_id) WHERE words > 0",
    "pre_roll": f"""{W}{HEARD}, {READING}, h AS (SELECT reader, se.doc_id, max(chunk) AS here FROM se JOIN hr USING (doc_id) WHERE start <= caret GROUP BY 1, 2),
k AS (SELECT reader, h.doc_id, chunk FROM h JOIN hr USING (doc_id) WHERE chunk < here AND NOT furniture QUALIFY row_number() OVER (PARTITION BY reader, h.doc_id ORDER BY chunk DESC) <= {coverage.PRE_ROLL})
SELECT h.reader, h.doc_id, here AS chunk, coalesce((SELECT min(chunk) FROM k WHERE k.reader = h.reader AND k.doc_id = h.doc_id), here) AS target FROM h""",
    "ladder_events": f"""{W}{HEARD}, l0 AS (SELECT hr.doc_id, hr.chunk, hr.stop, o.owes AND lead(hr.section) OVER v <> hr.section AS sm, lead(hr.section) OVER v AS nx, row_number() OVER v AS r FROM hr JOIN pow o ON o.doc_id = hr.doc_id AND o.section = hr.section WINDOW v AS (PARTITION BY hr.doc_id ORDER BY hr.chunk)),
l1 AS (SELECT * FROM l0 WHERE nx IS NOT NULL), l2 AS (SELECT doc_id, r, chunk, CASE WHEN NOT sm AND stop >= {coverage.CADENCE} THEN stop ELSE 0 END AS ck, CASE WHEN sm THEN 'summary' WHEN stop >= {coverage.CADENCE} THEN 'cloze' END AS event FROM l1 WHERE r = 1
  UNION ALL SELECT b.doc_id, b.r, b.chunk, CASE WHEN NOT b.sm AND b.stop - a.ck >= {coverage.CADENCE} THEN b.stop ELSE a.ck END, CASE WHEN b.sm THEN 'summary' WHEN b.stop - a.ck >= {coverage.CADENCE} THEN 'cloze' END FROM l2 a JOIN l1 b ON a.doc_id = b.doc_id AND b.r = a.r + 1)
SELECT doc_id, chunk, event FROM l2 WHERE event IS NOT NULL""",
    "effective_wpm": """WITH g AS (SELECT user_id AS reader, epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events), a AS (SELECT reader, count(*) AS n, coalesce(sum(least(gap, 1500)), 0) AS ms FROM g GROUP BY 1)
SELECT reader, (floor(CASE WHEN n > 25 AND ms > 4000 THEN n * 40 / (ms / 60000.0::DOUBLE) ELSE 185 END / 5 + 0.5) * 5)::BIGINT AS wpm FROM a""",
    "dq_entities": f"""{W}{CORPUS}, dv AS (SELECT 'entries' AS "check", (SELECT count(*) FROM en) AS value UNION ALL SELECT 'blank name', (SELECT count(*) FROM en WHERE trim(display) = '') UNION ALL SELECT 'below the floor', (SELECT count(*) FROM en WHERE kind = 'term' AND count < 2)
  UNION ALL SELECT 'too long a name', (SELECT count(*) FROM en WHERE len(string_split(display, ' ')) > 8) UNION ALL SELECT 'no section', (SELECT count(*) FROM en WHERE len(sections) = 0) UNION ALL SELECT 'names nothing', (SELECT count(*) FROM en WHERE kind = 'term' AND lower(display) IN {entities.NOT_NAMES})
  UNION ALL SELECT 'truncated', (SELECT coalesce(sum(truncated), 0) FROM en WHERE rank = 1) UNION ALL SELECT 'shared', (SELECT count(*) FROM cx WHERE docs > 1) UNION ALL SELECT 'documents not listed', (SELECT count(*) FROM cx WHERE docs <= 1000 AND docs <> len(string_split(listed, ','))))
SELECT 'entities' AS report, "check", value::BIGINT AS value, "check" IN ('entries', 'truncated', 'shared') OR value = 0 AS ok FROM dv""",
    "dq_checks": f"{W}{CHECKS} " + _report("checks", [("answer left in its carrier", "ck WHERE contains(carrier, answer)", 0), ("no blank", f"ck WHERE NOT contains(carrier, '{papers.BLANK}')", 0), ("shared carrier", "(SELECT 1 FROM ck GROUP BY doc_id, win, chunk HAVING count(*) > 1)", 0), ("windows", "(SELECT DISTINCT doc_id, win FROM ck)", None)]),
    "dq_paper": f"{W}{POOL} " + _report("paper", [("answer not among the options", "aq WHERE NOT contains(options, answer)", 0), ("empty prompt", "po WHERE trim(prompt) = ''", 0), ("one question twice", "(SELECT id FROM po GROUP BY id HAVING count(DISTINCT meaning) > 1)", 0), ("questions", "(SELECT DISTINCT meaning FROM po LIMIT 40)", None)]),
    "dq_coverage": f"{W}{SECTIONS} " + _report("coverage", [("owed after a perfect reading", f"{_perfect(True)} WHERE words > 0 AND NOT furniture AND state <> 'verified'", 0), ("verified after an empty reading", f"{_perfect(False)} WHERE words > 0 AND NOT furniture AND state = 'verified'", 0), ("sections", "pow WHERE words > 0", None)]),
    "dq_topics": f"{W}{TOPICS} " + _report("topics", [("document and section counted both", "(SELECT 1 FROM ex GROUP BY reader, doc_id, topic HAVING bool_or(section IS NULL) AND bool_or(section IS NOT NULL))", 0), ("names lost to normalisation", "psx WHERE level > 0 AND trim(base) = ''", 0), ("topics", "tp", None)]),
    "phrase_sites": f"{W}{SITES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block, s)::INTEGER AS rank, block, sentence AS line, hits, sum(hits) OVER (PARTITION BY doc_id)::BIGINT AS total FROM h QUALIFY rank <= 3",
    "phrase_docs": f"{W}{SITES} SELECT doc_id, sum(hits)::BIGINT AS total FROM h GROUP BY 1",
    "dq_phrases": f"{W}{SITES}, si AS (SELECT sentence AS line, row_number() OVER (PARTITION BY doc_id ORDER BY block, s) AS rank FROM h QUALIFY rank <= 3) " + _report("phrases", [("quotation without the phrase", "si WHERE NOT regexp_matches(lower(line), 'of[^a-z0-9]+the')", 0), ("more quotations than allowed", "si WHERE rank > 3", 0), ("quotations", "si", None)]),
    "term_salience": f"{W}{TOKENS} SELECT doc_id, i, key, core, score FROM dsl",
    "item_ids": f"{W}{CLOZE} SELECT DISTINCT doc_id, doc_id || ':cloze:' || {_slug('answer')} AS item FROM cq UNION SELECT DISTINCT doc_id, doc_id || ':acr:' || acronym FROM dsl WHERE acronym IS NOT NULL",
}

SQL["cloze_windows"] = SQL["cloze_candidates"]
