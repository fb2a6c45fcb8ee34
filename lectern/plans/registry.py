"""Queries over the given tables by name, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import expr
from lectern.operators import library, questions, reading, review, text, topics, vocab
from lectern.sources import tables as t
from lectern.plans import reader_log, search, study, study_sql
from lectern.plans.registry_sql import ACRONYM_ROWS, ANSWERS, BLOCKS, CATALOG, CORE, DOCS, FNV, KEY, MERGE, PACE, PAPERS, STATE, TOPICS
from lectern.streaming import readers

PHRASE, SEARCH, NOW, TODAY = "of the", "src1 en", "2024-02-01 00:00:00", "1998-06-01"

Query = Callable[[SparkSession, str], DataFrame]


def _state(s: SparkSession, d: str) -> DataFrame:
    return review.review_state(t.answers(s, d))


def _split(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as a local table, and a backup of it with changed, older and new rows."""
    rows = t.table(s, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").alias("updated"))
    local = rows.where("c_custkey % 5 <> 0")
    backup = rows.where("c_custkey % 3 <> 0").withColumn("c_name", F.concat("c_name", F.lit("*"))).withColumn("updated", F.col("updated") + (F.col("c_custkey") % 7 - 3))
    return local, backup


def _words(s: SparkSession, d: str) -> DataFrame:
    return text.tokens(t.docs(s, d)).select("word").distinct()


def _catalog(s: SparkSession, d: str) -> DataFrame:
    return t.docs(s, d).select("doc_id", "title", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n_words"))


def _index(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_words") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)
    title = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("old "), "title")).otherwise(F.col("title"))
    return _catalog(s, d).where("doc_id % 17 <> 0").select("doc_id", title.alias("title"), n.alias("n_words"))


QUERIES: dict[str, Query] = {
    "src_documents": lambda s, d: t.docs(s, d).select("doc_id", "title", F.length("text").alias("n_chars")),
    "doc_catalog": lambda s, d: _catalog(s, d).orderBy(F.col("doc_id").desc()),
    "lines": lambda s, d: text.lines(t.docs(s, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("line")).alias("longest")),
    "blocks": lambda s, d: text.blocks(t.docs(s, d)),
    "tokens": lambda s, d: text.tokens(t.docs(s, d)).groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"), F.sum(F.length("word")).alias("chars")),
    "clauses": lambda s, d: text.clauses(t.docs(s, d)),
    "block_words": lambda s, d: text.block_words(t.docs(s, d)),
    "read_time": lambda s, d: text.reading_times(t.docs(s, d)),
    "repeated_lines": lambda s, d: text.repeated_lines(t.docs(s, d)),
    "shared_lines": lambda s, d: text.frequent_lines(t.docs(s, d)),
    "clean_inline": lambda s, d: t.table(s, d, "pages").select("page_id", F.md5(expr.plain_inline(F.coalesce("html", F.lit(""))).cast("binary")).alias("digest")),
    "orp_index": lambda s, d: _words(s, d).select("word", expr.pivot_letter(F.col("word")).alias("pivot")),
    "sound_key": lambda s, d: _words(s, d).select("word", expr.sound_key(F.col("word")).alias("key")),
    "fnv1a": lambda s, d: t.table(s, d, "part").select("p_partkey", expr.fnv1a(F.col("p_name")).alias("h")),
    "title_norm": lambda s, d: t.docs(s, d).select("doc_id", expr.title_key(F.col("title")).alias("key")),
    "acronym_tag": lambda s, d: vocab.acronym_tags(t.docs(s, d)),
    "acronym_expand": lambda s, d: vocab.acronym_expansions(t.docs(s, d)),
    "phrase_sites": lambda s, d: vocab.phrase_sites(t.docs(s, d), PHRASE),
    "phrase_docs": lambda s, d: vocab.phrase_docs(t.docs(s, d), PHRASE),
    "catalog_search": lambda s, d: vocab.catalog_search(t.docs(s, d), SEARCH),
    "required_topics": lambda s, d: topics.required_topics(t.table(s, d, "benchmark")),
    "seeded_shuffle": lambda s, d: questions.seeded_shuffle(t.table(s, d, "orders"), "o_orderkey", "seed"),
    "review_state": _state,
    "difficulty": lambda s, d: review.difficulty(_state(s, d)),
    "weak_terms": lambda s, d: review.weak_terms(_state(s, d)),
    "due_list": lambda s, d: review.due_list(_state(s, d), NOW),
    "due_counts": lambda s, d: review.due_counts(_state(s, d), NOW),
    "interval_label": lambda s, d: review.interval_label(_state(s, d)),
    "review_horizon": lambda s, d: review.deadlines(t.table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("day")), TODAY),
    "paper_score": lambda s, d: review.paper_score(t.paper_answers(s, d)),
    "paper_trend": lambda s, d: review.paper_trend(t.paper_answers(s, d)),
    "paper_misses": lambda s, d: review.paper_misses(t.paper_answers(s, d)),
    "repeat_misses": lambda s, d: review.repeat_misses(t.paper_answers(s, d)),
    "recent_papers": lambda s, d: review.recent_papers(t.paper_answers(s, d)),
    "active_time": lambda s, d: reading.active_time(t.table(s, d, "events")),
    "pace_runs": lambda s, d: reading.pace_runs(t.pace_samples(s, d)),
    "pace_table": lambda s, d: reading.pace_table(t.pace_samples(s, d)),
    "pace_fit": lambda s, d: reading.pace_fit(t.pace_samples(s, d)),
    "pace_solve": lambda s, d: reading.pace_solve(t.pace_samples(s, d)),
    "away_sessions": lambda s, d: reading.sessions(t.table(s, d, "events")),
    "wpm_windows": lambda s, d: reading.wpm_windows(t.pace_samples(s, d)),
    "latency_ema": lambda s, d: reading.latency_ema(t.table(s, d, "events")),
    "away_sessions_stream": readers.sessions,
    "wpm_windows_stream": readers.windows,
    "answers_upsert_stream": readers.item_states,
    "snapshot_describe": lambda s, d: library.snapshot_describe({n: t.table(s, d, n) for n in ("documents", "events", "labels", "orders")}),
    "restore_merge": lambda s, d: library.restore_merge(*_split(s, d), ["c_custkey"], "updated"),
    "restore_counts": lambda s, d: library.restore_counts(library.restore_merge(*_split(s, d), ["c_custkey"], "updated")),
    "cascade_delete": lambda s, d: library.cascade_delete(t.table(s, d, "labels"), t.table(s, d, "documents").where("lang <> 'en'"), "doc_id"),
    "stale_rows": lambda s, d: library.stale_rows(_catalog(s, d), _index(s, d)),
}

_PLAIN = "coalesce(html, '')"
# The rules again without references back or looks around, which DuckDB's patterns lack. Digits at the end of a sentence
# take the next character along; the pages hold no address outside a tag, so that none needs to be left alone.
for _pattern, _by in (
    (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"</?[a-zA-Z][^>]*>", ""), (r"`([^`]+)`", r"\1"),
    (r"\*\*\*(.+?)\*\*\*|___(.+?)___", r"\1\2"), (r"\*\*(.+?)\*\*|__(.+?)__", r"\1\2"), (r"\*(\S(?:.*?\S)??)\*|_(\S(?:.*?\S)??)_", r"\1\2"), (r"~~(.+?)~~", r"\1"),
    (r"\[\s*\d{1,3}(?:\s*[,;–—-]\s*\d{1,3})*\s*\]", ""), (r'''([A-Za-z][.!?]["''’”)\]]?)\d{1,3}(?:\s*[,;–—-]\s*\d{1,3})*([^./\w]|$)''', r"\1\2"), (r"([A-Za-z])[*†‡§¶‖]+", r"\1"),
    (r"\s+([,.;:!?])", r"\1"), (r"\\([\\`*_{}\[\]()#+\-.!])", r"\1"), (r"\s+", " "),
):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', '{_by}', 'g')"

SQL: dict[str, str] = {
    "clean_inline": f"SELECT page_id, md5(trim({_PLAIN})) AS digest FROM pages",
    "src_documents": f"WITH {DOCS} SELECT doc_id, title, length(text)::INTEGER AS n_chars FROM dt",
    "doc_catalog": f"WITH {CATALOG} SELECT * FROM ct",
    "lines": f"WITH {DOCS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) SELECT doc_id, count(*) AS n, max(length(line))::INTEGER AS longest FROM l GROUP BY 1",
    "blocks": f"WITH {BLOCKS} SELECT doc_id, block, line FROM b",
    "tokens": f'WITH {BLOCKS} SELECT doc_id, block, count(*) AS n, max("at") AS last, sum(length(word))::BIGINT AS chars FROM tk GROUP BY ALL',
    "clauses": f"""WITH {BLOCKS} SELECT doc_id, block, (len(list_filter(words[:-2], lambda w: regexp_matches(w, '[,;:]["''’”)\\]]?$|[—–]$'))) + 1)::INTEGER AS n_clauses FROM bw""",
    "block_words": f"WITH {BLOCKS} SELECT doc_id, block, len(words)::INTEGER AS words FROM bw",
    "repeated_lines": f"""WITH {BLOCKS}, e0 AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS k FROM d),
e AS (SELECT doc_id, source, unnest(list_distinct([regexp_replace(k[1], '[0-9]+', '#', 'g'), regexp_replace(k[-1], '[0-9]+', '#', 'g')])) AS line FROM e0 WHERE len(k) > 0),
n AS (SELECT source, line, count(*) AS n FROM e GROUP BY ALL), q AS (SELECT source, count(*) AS docs FROM e0 WHERE len(k) > 0 GROUP BY ALL)
SELECT n.source, line, n FROM n JOIN q ON n.source IS NOT DISTINCT FROM q.source WHERE n >= greatest(2.0, docs * 0.35)""",
    "shared_lines": f"WITH {BLOCKS} SELECT line, count(DISTINCT doc_id) AS docs, count(*) AS times FROM b GROUP BY line HAVING count(DISTINCT doc_id) >= 2",
    "fnv1a": f"SELECT p_partkey, {FNV.format('p_name')} AS h FROM part",
    "title_norm": f"WITH {DOCS} SELECT doc_id, {KEY.format('title')} AS key FROM dt",
    "acronym_tag": f"""WITH {BLOCKS}, v(key, expansion, category) AS (VALUES {', '.join(map(str, vocab.ACRONYMS))}),
fo AS (SELECT key, expansion, unnest([key, key || 's', key || '''s']) AS core FROM v), w AS (SELECT doc_id, {CORE} AS core FROM tk WHERE regexp_matches(word, '[A-Z]'))
SELECT doc_id, key, expansion, count(*) AS n FROM w JOIN fo USING (core) GROUP BY ALL""",
    "catalog_search": f"WITH {DOCS} SELECT doc_id, title, source FROM dt WHERE contains(lower(concat_ws(' ', title, source, lang)), 'src1') AND contains(lower(concat_ws(' ', title, source, lang)), 'en')",
    "required_topics": f"WITH {TOPICS} SELECT topic, title, groups FROM rq",
    "seeded_shuffle": f"WITH h AS (SELECT o_orderkey, {FNV.format(chr(39) + 'seed' + chr(39) + ' || o_orderkey')} AS h FROM orders) SELECT o_orderkey, h, row_number() OVER (ORDER BY h, o_orderkey) AS place FROM h",
    "review_state": f"WITH {STATE} SELECT * FROM st",
    "answers_upsert_stream": f"WITH {STATE} SELECT reader, item, ease, reps, lapses FROM st",
    "difficulty": f"WITH {STATE} SELECT * FROM df",
    "weak_terms": f"WITH {STATE} SELECT item, max(weight) AS weight, count(*) AS readers FROM df GROUP BY 1 HAVING max(weight) > 0",
    "due_list": f"WITH {STATE} SELECT reader, item, due FROM st WHERE due <= TIMESTAMP '{NOW}' ORDER BY due, reader, item LIMIT 40",
    "due_counts": f"WITH {STATE} SELECT reader, count(*) FILTER (due <= TIMESTAMP '{NOW}') AS due, count(*) AS items FROM st GROUP BY 1",
    "interval_label": f"""WITH {STATE} SELECT reader, item, CASE WHEN days <= 0 THEN '10 minutes' WHEN days = 1 THEN '1 day' WHEN days < 30 THEN days || ' days' WHEN floor(days / 30.0 + 0.5) = 1 THEN '1 month' ELSE floor(days / 30.0 + 0.5)::INTEGER || ' months' END AS label FROM st""",
    "review_horizon": f"""WITH l AS (SELECT o_orderkey AS key, date_diff('day', DATE '{TODAY}', o_orderdate::DATE)::INTEGER AS n FROM orders) SELECT key, n AS days_left, CASE WHEN n > 0 THEN greatest(1, floor(n * 0.5))::BIGINT END AS horizon,
CASE WHEN n = 0 THEN 'today' WHEN n = 1 THEN 'tomorrow' WHEN n > 1 THEN 'in ' || n || ' days' WHEN n = -1 THEN 'yesterday' ELSE abs(n) || ' days ago' END AS label FROM l""",
    "paper_score": f"WITH {PAPERS} SELECT paper, kind, count(*) FILTER (correct) AS correct, count(*) AS total FROM pa GROUP BY GROUPING SETS ((paper), (paper, kind))",
    "paper_trend": f"""WITH {PAPERS}, r AS (SELECT *, row_number() OVER w AS rank, lead(percent) OVER w AS before, max(percent) OVER (PARTITION BY reader) AS best, count(*) OVER (PARTITION BY reader) AS papers FROM pp WINDOW w AS (PARTITION BY reader ORDER BY day DESC)),
m AS (SELECT *, round(avg(percent) FILTER (rank <= 3) OVER (PARTITION BY reader), 4) AS mean3 FROM r) SELECT reader, papers, percent AS latest, percent - before AS change, best, mean3 FROM m WHERE rank = 1""",
    "paper_misses": f"WITH {PAPERS} SELECT paper, item, kind, count(*) AS misses FROM pa WHERE NOT correct GROUP BY ALL",
    "repeat_misses": f"WITH {PAPERS} SELECT reader, item, count(DISTINCT paper) AS papers, max(ts) AS last FROM pa WHERE NOT correct GROUP BY ALL HAVING count(DISTINCT paper) >= 2",
    "recent_papers": f"WITH {PAPERS} SELECT paper, day, percent FROM pp ORDER BY day DESC, paper LIMIT 30",
    "active_time": "WITH g AS (SELECT user_id AS reader, epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) SELECT reader, count(*) AS events, coalesce(sum(least(gap, 1500)), 0)::BIGINT AS active_ms FROM g GROUP BY 1",
    "pace_table": f"WITH {PACE} SELECT * FROM pt",
    "pace_runs": f"""WITH {PACE}, n AS (SELECT *, CASE WHEN tenths IS NOT DISTINCT FROM lag(tenths) OVER w THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY voice ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY voice ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM n) SELECT voice, run, tenths, count(*) AS samples, sum(words)::BIGINT AS words FROM r GROUP BY ALL""",
    "pace_fit": f"WITH {PACE} SELECT * FROM pf",
    "pace_solve": f"""WITH {PACE}, q AS (SELECT *, least(2.0, greatest(0.5, floor((200 - intercept) / slope * 10 + 0.5) / 10))::DOUBLE AS rate FROM pf),
e AS (SELECT *, greatest(1, floor((intercept + slope * rate) / 5 + 0.5) * 5)::BIGINT AS expected_wpm FROM q) SELECT voice, rate, expected_wpm, abs(expected_wpm - 200) > 5 AS clamped FROM e""",
    "away_sessions": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id AS reader, min(ts) AS started, max(ts) + INTERVAL 15 MINUTE AS ended, count(*) AS events FROM s GROUP BY user_id, k""",
    "wpm_windows": f"""WITH {PACE}, w AS (SELECT 'tumbling' AS kind, date_trunc('hour', ts) AS started, words, ms FROM p UNION ALL SELECT 'sliding', time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE, words, ms FROM p, range(4) r(k))
SELECT kind, started, sum(words)::BIGINT AS words, floor(sum(words) / (sum(ms) / 60000.0::DOUBLE) + 0.5)::BIGINT AS wpm FROM w GROUP BY ALL HAVING sum(ms) > 0""",
    "orp_index": f"""WITH {BLOCKS}, w AS (SELECT DISTINCT word, list_filter(string_split(word, ''), lambda c: c <> '') AS l FROM tk), p AS (SELECT word, list_filter(range(len(l)), lambda i: regexp_matches(l[i + 1], '[A-Za-z0-9À-ɏ]')) AS pl FROM w)
SELECT word, coalesce(pl[CASE WHEN len(pl) <= 1 THEN 0 WHEN len(pl) <= 5 THEN 1 WHEN len(pl) <= 9 THEN 2 ELSE 3 END + 1], 0)::INTEGER AS pivot FROM p""",
    "latency_ema": "SELECT user_id AS reader, round(list_reduce(list(value ORDER BY ts, event_id), lambda s, x: s * 0.7 + x * 0.3), 6) AS ema FROM events GROUP BY 1",
    "acronym_expand": f"""WITH {BLOCKS}, fm AS (SELECT k || e AS form, x || e AS spoken FROM (SELECT key AS k, expansion AS x, unnest(['', 's', chr(39) || 's', '’s']) AS e FROM ({ACRONYM_ROWS}))),
w AS (SELECT doc_id, block, "at", word, {CORE} AS core FROM tk), e AS (SELECT doc_id, block, string_agg(CASE WHEN spoken IS NULL THEN word ELSE replace(word, core, spoken) END, ' ' ORDER BY "at") AS spoken, count(spoken) AS n FROM w LEFT JOIN fm ON form = core GROUP BY 1, 2)
SELECT doc_id, block, spoken FROM e WHERE n > 0""",
    "read_time": f"""WITH {DOCS}, r AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::INTEGER AS words FROM d), q AS (SELECT *, words / 185.0::DOUBLE * 60 AS s FROM r),
m AS (SELECT *, floor(s / 60)::BIGINT AS m, floor(s % 60 + 0.5)::BIGINT AS k FROM q) SELECT doc_id, words, round(s, 3) AS seconds, CASE WHEN s <= 0 THEN '0s' WHEN m = 0 THEN k || 's' WHEN m < 60 THEN CASE WHEN k > 0 THEN m || 'm ' || k || 's' ELSE m || 'm' END ELSE (m // 60) || 'h ' || (m % 60) || 'm' END AS label FROM m""",
    "wpm_windows_stream": "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "snapshot_describe": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ("documents", "events", "labels", "orders")),
    "restore_merge": f"WITH {MERGE} SELECT * FROM m",
    "restore_counts": f"WITH {MERGE} SELECT action, count(*) AS n FROM m GROUP BY 1",
    "cascade_delete": "SELECT * FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en')",
    "stale_rows": f"""WITH {CATALOG}, ix AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'old ' || title ELSE title END AS t, n_words + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS n FROM ct WHERE doc_id % 17 <> 0)
SELECT doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN n <> n_words THEN 'stale' WHEN t <> title THEN 'renamed' ELSE 'fresh' END AS state FROM ct LEFT JOIN ix USING (doc_id)""",
}


def queries() -> dict[str, Query]:
    return QUERIES | study.QUERIES | reader_log.QUERIES | search.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | study_sql.SQL | reader_log.SQL | search.SQL
