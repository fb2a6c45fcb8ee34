"""Queries over logs of readers: presence, results of checks, boundaries of speech, each with SQL of its own."""

from __future__ import annotations

from lectern.operators import presence, structure
from lectern.plans.study_sql import HEARD
from lectern.sources import tables as t
from lectern.streaming import presence as stream

QUERIES = {
    "presence_lapses": lambda s, d: presence.checks(t.table(s, d, "events")),
    "presence_lapses_stream": stream.presence_checks,
    "check_results": lambda s, d: presence.latest_results(t.as_check_results(t.table(s, d, "events")).withColumnRenamed("ts", "ms")),
    "check_results_stream": stream.check_results,
    "boundary_tokens": lambda s, d: presence.boundary_tokens(t.boundaries(s, d), structure.chunks(structure.blocks(t.page_docs(s, d)))),
}


def _checks(until: str) -> str:
    """A reader's checks by self-join of neighbouring events, up to a moment."""
    return f"""WITH m AS (SELECT {until} AS wm FROM events),
e AS (SELECT user_id AS reader, date_trunc('millisecond', ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events, m WHERE user_id IS NOT NULL AND date_trunc('millisecond', ts) <= wm),
n AS (SELECT a.reader, a.ts, b.ts AS after FROM e a LEFT JOIN e b ON b.reader = a.reader AND b.i = a.i + 1),
x AS (SELECT reader, 'raised' AS kind, ts + INTERVAL 90 SECOND AS "at" FROM n WHERE after IS NULL OR after > ts + INTERVAL 90 SECOND
  UNION ALL SELECT reader, 'missed', ts + INTERVAL 93500 MILLISECOND FROM n WHERE after IS NULL OR after > ts + INTERVAL 93500 MILLISECOND
  UNION ALL SELECT reader, 'cleared', after FROM n WHERE after > ts + INTERVAL 90 SECOND)
SELECT x.* FROM x, m WHERE "at" <= wm"""


LAST = "date_trunc('millisecond', max(ts))"

_RESULTS = """WITH r AS (SELECT ts, event_id, user_id AS reader, (props->>'$.k')::BIGINT AS doc_id, (floor(floor(value * 2) / 250) * 250 + 250)::INTEGER AS "to" FROM events WHERE event_type = 'click' AND (props->>'$.k') IS NOT NULL)
SELECT reader, doc_id, ("to" - 250)::INTEGER AS begin, "to", 3 AS blanks, (event_id % 4)::INTEGER AS recalled FROM r QUALIFY row_number() OVER (PARTITION BY reader, doc_id, "to" ORDER BY {order} DESC, event_id DESC) = 1"""

SQL = {
    "presence_lapses": _checks(LAST),
    "presence_lapses_stream": _checks(f"{LAST} - INTERVAL 1 HOUR"),
    "check_results": _RESULTS.format(order="ts"),
    "check_results_stream": _RESULTS.format(order="epoch_ms(ts)"),
    "away_sessions_stream": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g), f AS (SELECT user_id AS reader, min(ts) AS started, max(ts) + INTERVAL 15 MINUTE AS ended, count(*) AS events FROM s GROUP BY user_id, k)
SELECT * FROM f WHERE ended <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""",
    "boundary_tokens": f"""WITH RECURSIVE {HEARD}, bd AS (SELECT event_id, ts, user_id AS reader, (props->>'$.k')::BIGINT AS doc_id, (event_id % 4)::INTEGER AS chunk, floor(value)::INTEGER AS c FROM events WHERE (props->>'$.k') IS NOT NULL),
wd AS (SELECT doc_id, chunk, start, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS j FROM pch),
wo AS (SELECT doc_id, chunk, start + j AS token, sum(length(w) + 1) OVER (PARTITION BY doc_id, chunk ORDER BY j) - length(w) - 1 AS o FROM wd),
bt AS (SELECT bd.*, coalesce(max(token) FILTER (o <= c), min(token), -1) AS token FROM bd LEFT JOIN wo USING (doc_id, chunk) GROUP BY ALL)
SELECT event_id, reader, doc_id, chunk, token::BIGINT AS token, token > coalesce(max(token) OVER (PARTITION BY reader, doc_id, chunk ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS advances FROM bt""",
}
