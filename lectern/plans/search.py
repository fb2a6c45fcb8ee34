"""Queries over outlines, dictated text, look-alike titles and records of a backup, with SQL of their own but for dictated text, whose choice of windows is too slow in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.expr import title_key
from lectern.operators import dictation, library, outline, records, structure, text, topics
from lectern.operators.vocab import CORE
from lectern.plans.registry_sql import BLOCKS as LINE_BLOCKS
from lectern.plans.registry_sql import KEY
from lectern.plans.study_sql import SECTIONS
from lectern.sources import tables as t

#: What is looked for in the outline; characters of a line that may be a title.
NEEDLE, TITLE_CHARS = "The  Of", 80


def _sections(s: SparkSession, d: str) -> DataFrame:
    return structure.sections(structure.blocks(t.page_docs(s, d)))


def _vocabulary(s: SparkSession, d: str) -> DataFrame:
    """``scope, term``: the capitalised words of four letters or more that a document holds which a conversation is about; it is the scope."""
    cores = F.transform(F.split("text", r"\s+"), lambda w: F.regexp_extract(w, CORE, 1))
    words = F.explode(F.array_distinct(F.filter(cores, lambda w: w.rlike("^[A-Z][A-Za-z]{3,}$"))))
    about = t.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return t.docs(s, d).join(about, "doc_id", "left_semi").select(F.col("doc_id").alias("scope"), words.alias("term"))


def _dictated(s: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as dictated summaries of the document that has the conversation's number."""
    return t.table(s, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.col("conv_id").alias("scope"), "text")


def _corrections(s: SparkSession, d: str) -> DataFrame:
    out = dictation.reconciled(_dictated(s, d), library.kept(_vocabulary(s, d)))
    told = F.array_join(F.transform("corrections", lambda c: F.concat_ws(">", c["from"], c["to"])), "|")
    return out.select("id.conv_id", "id.turn", F.md5(F.col("text").cast("binary")).alias("digest"), told.alias("corrections"))


def _titles(s: SparkSession, d: str) -> DataFrame:
    """Short lines of documents as titles, in their normal form."""
    return text.blocks(t.docs(s, d)).where(F.length("line") <= TITLE_CHARS).select(title_key(F.col("line")).alias("title")).where("title <> ''")


def _topics(s: SparkSession, d: str) -> DataFrame:
    return t.docs(s, d).select(title_key(F.col("title")).alias("topic")).where("topic <> ''")


def _look_alikes(s: SparkSession, d: str) -> DataFrame:
    """``title, topic``: a page's first second-level heading is listed as a look-alike of its first heading."""
    rows = _sections(s, d).where("coalesce(part, 1) = 1").groupBy("doc_id").agg(
        F.min_by("base", F.when(F.col("level") == 1, F.col("section"))).alias("h1"), F.min_by("base", F.when(F.col("level") == 2, F.col("section"))).alias("h2")
    )
    return rows.select(title_key(F.col("h2")).alias("title"), title_key(F.col("h1")).alias("topic")).where("title <> '' AND topic <> '' AND title <> topic")


def _records(s: SparkSession, d: str) -> DataFrame:
    """Rows of four tables as records of a backup: documents, reader events as sessions, turns as reviews, labels as papers."""
    docs = t.table(s, d, "documents").select(F.lit("docs").alias("kind"), "doc_id", F.struct(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("title"), F.col("text").alias("source")).alias("r"))
    k = F.get_json_object("props", "$.k")
    sessions = t.table(s, d, "events").select(F.lit("sessions").alias("kind"), F.col("event_id").alias("doc_id"), F.struct(F.when(F.col("event_type") != "error", k).alias("docId"), F.floor("value").alias("tokenIndex")).alias("r"))
    reviews = t.table(s, d, "conversations").select(F.lit("reviews").alias("kind"), F.col("conv_id").alias("doc_id"), F.struct(F.col("role").alias("id"), F.col("conv_id").cast("string").alias("docId"), F.when(F.length("text") <= 400, F.col("text")).alias("prompt"), F.col("turn").cast("string").alias("dueAt")).alias("r"))
    exams = t.table(s, d, "labels").select(F.lit("exams").alias("kind"), "doc_id", F.struct(F.when(F.col("toxic") == 1, "").otherwise(F.col("doc_id").cast("string")).alias("id"), F.lit(1).alias("at"), F.col("quality").alias("correct"), F.lit(1).alias("total"), F.array("toxic").alias("missed")).alias("r"))
    rows = [x.select("kind", "doc_id", F.to_json("r").alias("payload")) for x in (docs, sessions, reviews, exams)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def _swept(s: SparkSession, d: str) -> DataFrame:
    """Summaries of pages' sections, stored under the section's own title by readers of even numbers, under its full name by others."""
    rows = _sections(s, d)
    named = outline.qualified(rows).select("doc_id", "section", "base", "name")
    prompt = F.coalesce(F.when(F.col("reader") % 2 == 0, F.trim("base")).otherwise(F.col("name")), F.lit("gone"))
    items = t.summaries(s, d).join(named, ["doc_id", "section"], "left").withColumn("prompt", prompt).drop("base", "name")
    return outline.summary_sweep(items, rows)


QUERIES = {
    "chapter_titles": lambda s, d: outline.chapters(_sections(s, d)).select("doc_id", "section", "level", "base", "chapter"),
    "qualified_title": lambda s, d: outline.qualified(_sections(s, d)).select("doc_id", "section", "name"),
    "outline_search": lambda s, d: outline.search(_sections(s, d), NEEDLE).select("doc_id", "section", "base", "chapter"),
    "ambiguous_titles": lambda s, d: outline.ambiguous(_sections(s, d)),
    "summary_sweep": lambda s, d: _swept(s, d).select("reader", "doc_id", "section", "action", "prompt", "name"),
    "summary_sweep_counts": lambda s, d: _swept(s, d).groupBy("action").agg(F.count(F.lit(1)).alias("n")),
    "transcript_terms": _corrections,
    "near_miss_alarm": lambda s, d: topics.near_misses(_titles(s, d), _topics(s, d), _look_alikes(s, d)),
    "topic_resembles": lambda s, d: topics.resembling(_topics(s, d).select(F.col("topic").alias("title")), _look_alikes(s, d)).withColumn("topics", F.array_join("topics", "|")),
    "validate_records": lambda s, d: records.validated(_records(s, d)).where("reason IS NOT NULL").select("kind", "doc_id", "reason"),
    "validate_counts": lambda s, d: records.counted(records.validated(_records(s, d))),
}

_SQUEEZED = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
CHAPTERS = f"""WITH RECURSIVE {SECTIONS}, oc AS (SELECT s.doc_id, s.section, s.level, s.base, s.intercept, (SELECT arg_max(e.base, e.section) FROM psx e WHERE e.doc_id = s.doc_id AND e.section < s.section AND e.level < s.level) AS chapter FROM psx s),
oq AS (SELECT *, CASE WHEN coalesce(trim(chapter), '') = '' THEN trim(base) WHEN trim(base) = '' THEN trim(chapter) WHEN {_SQUEEZED.format("chapter")} = {_SQUEEZED.format("base")} THEN trim(base) ELSE trim(chapter) || ' — ' || trim(base) END AS name FROM oc)"""


def _sound(x: str) -> str:
    """The consonant skeleton, by SQL."""
    letters = f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
    for a, b in (("ph", "f"), ("ck", "k"), ("ce", "se"), ("ci", "si"), ("cy", "sy"), ("c", "k"), ("q", "k"), ("z", "s"), ("x", "ks")):
        letters = f"replace({letters}, '{a}', '{b}')"
    bare = f"left({letters}, 1) || regexp_replace(substring({letters}, 2), '[aeiou]', '', 'g')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        bare = f"regexp_replace({bare}, '{c}+', '{c}', 'g')"
    return bare


_MATCHED = f"""{LINE_BLOCKS}, nt AS (SELECT DISTINCT {KEY.format("line")} AS title FROM b WHERE length(line) <= 80), np AS (SELECT DISTINCT {KEY.format("title")} AS topic FROM dt WHERE {KEY.format("title")} <> '')"""
_ALIKE = f"""la0 AS (SELECT doc_id, arg_min(base, section) FILTER (level = 1) AS h1, arg_min(base, section) FILTER (level = 2) AS h2 FROM psx WHERE coalesce(part, 1) = 1 GROUP BY 1),
la AS (SELECT DISTINCT {KEY.format("h2")} AS title, {KEY.format("h1")} AS topic FROM la0 WHERE {KEY.format("h2")} <> '' AND {KEY.format("h1")} <> '' AND {KEY.format("h2")} <> {KEY.format("h1")})"""
RECORDS = r"""WITH rc AS (SELECT 'docs' AS kind, doc_id, CASE WHEN doc_id IS NULL THEN 'id: missing' WHEN lang IS NULL THEN 'title: missing' WHEN text IS NULL THEN 'source: missing' WHEN regexp_replace(text, '\s+', '', 'g') = '' THEN 'source: empty' END AS reason FROM documents
UNION ALL SELECT 'sessions', event_id, CASE WHEN event_type = 'error' OR event_type IS NULL OR props->>'$.k' IS NULL THEN 'docId: missing' WHEN value IS NULL THEN 'tokenIndex: missing' END FROM events
UNION ALL SELECT 'reviews', conv_id, CASE WHEN role IS NULL THEN 'id: missing' WHEN conv_id IS NULL THEN 'docId: missing' WHEN text IS NULL OR length(text) > 400 THEN 'prompt: missing' WHEN turn IS NULL THEN 'dueAt: missing' ELSE 'dueAt: no number' END FROM conversations
UNION ALL SELECT 'exams', doc_id, CASE WHEN toxic = 1 THEN 'id: empty' WHEN quality IS NULL THEN 'correct: missing' END FROM labels)"""

SWEEP = f"""{CHAPTERS}, si AS (SELECT DISTINCT user_id AS reader, (props->>'$.k')::BIGINT AS doc_id, (event_id % 4)::INTEGER AS section FROM events WHERE event_type = 'purchase' AND (props->>'$.k') IS NOT NULL),
sw AS (SELECT reader, si.doc_id, si.section, CASE WHEN x.doc_id IS NULL THEN 'unjudged' WHEN x.words < 60 THEN 'remove' WHEN oq.name <> '' AND reader % 2 = 0 AND oq.name <> trim(x.base) THEN 'rename' ELSE 'keep' END AS action,
  CASE WHEN x.doc_id IS NULL THEN 'gone' WHEN reader % 2 = 0 THEN trim(x.base) ELSE oq.name END AS prompt, oq.name
  FROM si LEFT JOIN psx x ON x.doc_id = si.doc_id AND x.section = si.section LEFT JOIN oq ON oq.doc_id = si.doc_id AND oq.section = si.section)"""

SQL = {
    "summary_sweep": f"{SWEEP} SELECT reader, doc_id, section, action, prompt, name FROM sw",
    "summary_sweep_counts": f"{SWEEP} SELECT action, count(*) AS n FROM sw GROUP BY 1",
    "sound_key": f"WITH {LINE_BLOCKS} SELECT word, {_sound('word')} AS key FROM (SELECT DISTINCT word FROM tk)",
    "chapter_titles": f"{CHAPTERS} SELECT doc_id, section, level, base, chapter FROM oc",
    "qualified_title": f"{CHAPTERS} SELECT doc_id, section, name FROM oq",
    "outline_search": f"{CHAPTERS} SELECT doc_id, section, base, chapter FROM oc WHERE contains({_SQUEEZED.format('base')}, 'the of') OR coalesce(contains({_SQUEEZED.format('chapter')}, 'the of'), false)",
    "ambiguous_titles": f"""{CHAPTERS} SELECT doc_id, count(*) AS stops, count(*) FILTER (n > 1) AS shared, count(DISTINCT base) AS titles, count(DISTINCT name) AS names FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, base) AS n FROM oq WHERE intercept) GROUP BY 1""",
    "near_miss_alarm": f"""WITH RECURSIVE {SECTIONS}, {_MATCHED}, {_ALIKE} SELECT title, topic, levenshtein(title, topic)::INTEGER AS distance FROM nt, np WHERE length(title) >= 8 AND abs(length(title) - length(topic)) <= 2 AND levenshtein(title, topic) BETWEEN 1 AND 2
AND title NOT IN (SELECT topic FROM np) AND title NOT IN (SELECT title FROM la)""",
    "topic_resembles": f"WITH RECURSIVE {SECTIONS}, {_MATCHED}, {_ALIKE} SELECT title, string_agg(topic, '|' ORDER BY topic) AS topics FROM la WHERE title IN (SELECT topic FROM np) GROUP BY 1",
    "validate_records": f"{RECORDS} SELECT * FROM rc WHERE reason IS NOT NULL",
    "validate_counts": f"{RECORDS} SELECT kind, coalesce(reason, 'good') AS reason, count(*) AS n FROM rc GROUP BY 1, 2",
}
