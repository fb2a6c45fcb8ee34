"""What a reader has been through, what was asked of it, and what is still owed, section by section.

Sessions are ``reader, doc_id, caret, checked``: the word reached and the word of the last check. Windows are the spot
checks ``reader, doc_id, from, to, blanks, recalled``; summaries are ``reader, doc_id, section``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.expr import half_up, title_key
from lectern.operators.text import STOP_WORDS

#: Words between two spot checks; marks of a gauge; sentences that are heard again.
CADENCE, GAUGE, PRE_ROLL = 250, 24, 2

SESSION = ["reader", "doc_id"]


#: Parts that rows of one key are dealt to where a few keys hold most rows.
PARTS = 16


def spread(rows: DataFrame, few: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """The inner join of ``rows`` with a smaller side on keys of which a few may hold most rows: those are dealt to parts by ``by``, and the smaller side's rows are there for each part."""
    left = rows.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int"))
    right = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return left.join(right, [*on, "_part"]).drop("_part")


def read_share(caret: Column, start: Column, stop: Column) -> Column:
    """The share of a range of words that is behind the caret; an empty range is read once the caret is past it."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (caret + 1 - start) / (stop - start)))
    return F.when(stop <= start, F.when(caret + 1 >= stop, 1.0).otherwise(0.0)).otherwise(share)


def cloze_by_section(windows: DataFrame, sections: DataFrame) -> DataFrame:
    """``reader, doc_id, section, windows, blanks, recalled``: a window counts for every section that it overlaps.

    Windows and sections of one document meet by the cadence legs that they touch, so that no pair meets in vain.
    """
    legs = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / CADENCE), F.floor((F.col(b) - 1) / CADENCE)))
    w = windows.where("to > from").withColumn("leg", legs("from", "to"))
    s = sections.where("token_to > token_from").select("doc_id", "section", "token_from", "token_to").withColumn("leg", legs("token_from", "token_to"))
    met = spread(w, s, ["doc_id", "leg"], ["reader"]).where((F.col("to") > F.col("token_from")) & (F.col("from") < F.col("token_to")))
    # A pair is taken in the first leg that both touch.
    met = met.where(F.col("leg") == F.floor(F.greatest("from", "token_from") / CADENCE))
    return met.groupBy(*SESSION, "section").agg(F.count(F.lit(1)).alias("windows"), F.sum("blanks").alias("blanks"), F.sum("recalled").alias("recalled"))


def section_coverage(sessions: DataFrame, owing: DataFrame, windows: DataFrame, summaries: DataFrame) -> DataFrame:
    """``reader, doc_id, section, title, words, read, summary, windows, blanks, recalled, state, recall``."""
    checked = cloze_by_section(windows, owing)
    given = summaries.select(*SESSION, "section", F.lit(True).alias("given")).distinct()
    read = owing.join(sessions.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = spread(sessions, read, ["doc_id"], ["reader"]).join(checked, [*SESSION, "section"], "left").join(given, [*SESSION, "section"], "left")
    rows = rows.withColumn("read", read_share(F.col("caret"), F.col("token_from"), F.col("token_to")))
    summary = F.when(~F.col("owes"), "n/a").when(F.coalesce("given", F.lit(False)), "done").otherwise("owed")
    some = F.coalesce("windows", F.lit(0))
    rows = rows.withColumn("summary", summary)
    due = F.lit(1) + (F.col("summary") != "n/a").cast("int")
    done = (some > 0).cast("int") + (F.col("summary") == "done").cast("int")
    state = F.when(F.col("furniture"), "verified").when(F.col("read") < 1, "unread").when(done == 0, "unchecked").when(done == due, "verified").otherwise("partial")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    recall = F.when(F.col("blanks") > 0, F.round(F.col("recalled") / F.col("blanks"), 6))
    return rows.select(*SESSION, "section", F.col("base").alias("title"), F.when(F.col("furniture"), 0).otherwise(F.col("words")).alias("words"), F.round("read", 6).alias("read"), "summary", zero("windows"), zero("blanks"), zero("recalled"), state.alias("state"), recall.alias("recall"))


def doc_coverage(covered: DataFrame, windows: DataFrame) -> DataFrame:
    """One row a session: sections and words by state, summaries owed and given; a window counts once."""
    own = covered.where("words > 0")
    n = lambda c: F.count_if(c)
    out = own.groupBy(*SESSION).agg(
        *(n(F.col("state") == s).alias(s) for s in ("verified", "partial", "unchecked", "unread")),
        F.sum(F.when(F.col("state") == "verified", F.col("words")).otherwise(0)).alias("verified_words"),
        F.sum(half_up(F.col("words") * F.col("read"))).alias("read_words"), F.sum("words").alias("total_words"),
        n(F.col("summary") == "owed").alias("summaries_owed"), n(F.col("summary") == "done").alias("summaries_given"),
    )
    sat = windows.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("windows"), F.sum("blanks").cast("long").alias("blanks"), F.sum("recalled").cast("long").alias("recalled"))
    return out.join(sat, SESSION, "left").na.fill(0, ["windows", "blanks", "recalled"])


def state_words(covered: DataFrame) -> DataFrame:
    """``reader, state, words, share``: each state's share of the words that a reader's documents hold."""
    by = covered.groupBy("reader", "state").agg(F.sum("words").alias("words"))
    return by.withColumn("share", F.round(F.col("words") / F.sum("words").over(Window.partitionBy("reader")), 6))


def next_to_verify(covered: DataFrame) -> DataFrame:
    """The section a session should go to next: unchecked, then partial, then unread; the longest, the earliest of equals."""
    rank = F.when(F.col("state") == "unchecked", 0).when(F.col("state") == "partial", 1).otherwise(2)
    order = Window.partitionBy(*SESSION).orderBy(rank, F.col("words").desc(), "section")
    rows = covered.where("words > 0 AND state <> 'verified'").withColumn("k", F.row_number().over(order))
    return rows.where("k = 1").select(*SESSION, "section", "state", "words")


def next_stop(sessions: DataFrame, sections: DataFrame, summaries: DataFrame, words: DataFrame) -> DataFrame:
    """``reader, doc_id, to_check, to_summary``: words to the next spot check, and to the next boundary that asks for a summary."""
    enters = Window.partitionBy("doc_id").orderBy("section")
    nxt = lambda c: F.lead(c).over(enters)
    bounds = sections.select("doc_id", "section", "token_to", nxt("token_from").alias("at"), (~F.col("furniture") & ~nxt("furniture") & nxt("intercept")).alias("stops"))
    given = summaries.select(*SESSION, "section", F.lit(True).alias("given")).distinct()
    rows = sessions.join(bounds.where("stops"), "doc_id").join(given, [*SESSION, "section"], "left")
    ahead = rows.where((F.col("caret") < F.col("token_to")) & F.col("given").isNull()).groupBy(*SESSION).agg(F.min_by("at", "section").alias("at"))
    past = sections.groupBy("doc_id").agg(F.max("token_to").alias("end"))
    # Past the last word all sections lie ahead again, as the place falls back to the first one.
    again = rows.join(past, "doc_id").where((F.col("caret") >= F.col("end")) & F.col("given").isNull()).groupBy(*SESSION).agg(F.min_by("at", "section").alias("back"))
    out = sessions.join(words, "doc_id").join(ahead, SESSION, "left").join(again, SESSION, "left")
    to_check = F.when(F.col("caret") < F.col("n_words"), F.greatest(F.lit(0), F.lit(CADENCE) - (F.col("caret") - F.col("checked"))))
    at = F.coalesce("at", "back")
    return out.select(*SESSION, to_check.cast("int").alias("to_check"), F.when(at.isNotNull(), F.greatest(F.lit(0), at - F.col("caret"))).cast("int").alias("to_summary"))


def check_gauge(sessions: DataFrame, heard: DataFrame, words: DataFrame, most: int = GAUGE) -> DataFrame:
    """``reader, doc_id, done, total, scaled``: sentences outside furniture that overlap the leg to the next check."""
    rows = sessions.join(words, "doc_id").where("caret < n_words").join(heard.where("NOT furniture"), "doc_id")
    rows = rows.where((F.col("stop") > F.col("checked")) & (F.col("start") < F.col("checked") + CADENCE))
    out = rows.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stop") <= F.col("caret")).alias("k"))
    scaled = F.col("n") > most
    return out.select(*SESSION, F.when(scaled, half_up(F.col("k") / F.col("n") * most)).otherwise(F.col("k")).alias("done"), F.least("n", F.lit(most)).cast("long").alias("total"), scaled.alias("scaled"))


def active_block(sessions: DataFrame, blocks: DataFrame) -> DataFrame:
    """``reader, doc_id, block, active``: -1 before a block, the caret inside, the block's end once it is passed."""
    stop = F.col("start") + F.col("words")
    active = F.when(F.col("caret") >= stop, stop).when(F.col("caret") < F.col("start"), -1).otherwise(F.col("caret"))
    return sessions.join(blocks.where("words > 0"), "doc_id").select(*SESSION, "block", active.cast("long").alias("active"))


def pre_roll(sessions: DataFrame, heard: DataFrame, sentences: int = PRE_ROLL) -> DataFrame:
    """``reader, doc_id, chunk, target``: the sentence at the caret, and the one to hear again from, furniture not counted."""
    rows = sessions.join(heard, "doc_id").where(F.col("start") <= F.col("caret"))
    here = rows.groupBy(*SESSION).agg(F.max("chunk").alias("here"))
    back = rows.join(here, SESSION).where((F.col("chunk") < F.col("here")) & ~F.col("furniture"))
    back = back.withColumn("k", F.row_number().over(Window.partitionBy(*SESSION).orderBy(F.col("chunk").desc()))).where(F.col("k") <= sentences)
    target = back.groupBy(*SESSION).agg(F.min("chunk").alias("target"))
    return here.join(target, SESSION, "left").select(*SESSION, F.col("here").alias("chunk"), F.coalesce("target", "here").alias("target"))


def ladder(heard: DataFrame, owing: DataFrame) -> DataFrame:
    """``doc_id, chunk, event``: the stops of a reader who answers all: at most one at a sentence's end.

    A summary where the section that is left owes one, else a spot check once 250 words are heard since the last
    check. The fold over a document's sentences keeps the last check's place and the stops.
    """
    of = owing.select("doc_id", "section", "owes")
    rows = heard.join(of, ["doc_id", "section"])
    leaves = F.lead("section").over(Window.partitionBy("doc_id").orderBy("chunk"))
    rows = rows.withColumn("next", leaves).where("next IS NOT NULL")
    rows = rows.withColumn("summary", F.col("owes") & (F.col("next") != F.col("section")))
    logs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "stop", "summary"))).alias("log"))  # of one document
    start = F.struct(F.lit(0).cast("long").alias("checked"), F.array().cast("array<struct<chunk:int,event:string>>").alias("events"))

    def step(s, x):
        cloze = ~x["summary"] & (x["stop"] - s["checked"] >= CADENCE)
        event = F.struct(x["chunk"].cast("int").alias("chunk"), F.when(x["summary"], "summary").otherwise("cloze").alias("event"))
        return F.struct(F.when(cloze, x["stop"]).otherwise(s["checked"]).cast("long").alias("checked"), F.when(x["summary"] | cloze, F.concat(s["events"], F.array(event))).otherwise(s["events"]).alias("events"))

    return logs.select("doc_id", F.explode(F.aggregate("log", start, step, lambda s: s["events"])).alias("e")).select("doc_id", "e.*")


def units(covered: DataFrame, titles: DataFrame) -> DataFrame:
    """``reader, doc_id, section, title, words, read_words, verified_words``: each section with words, and each document (no section)."""
    own = covered.where("words > 0").withColumn("verified_words", F.when(F.col("state") == "verified", F.col("words")).otherwise(0)).withColumn("read_words", half_up(F.col("words") * F.col("read")))
    parts = own.select(*SESSION, "section", "title", "words", "read_words", "verified_words")
    whole = own.groupBy(*SESSION).agg(*(F.sum(c).alias(c) for c in ("words", "read_words", "verified_words"))).join(titles, "doc_id")
    return parts.withColumns({c: F.col(c).cast("long") for c in ("words", "read_words", "verified_words")}).unionByName(whole.select(*SESSION, F.lit(None).cast("int").alias("section"), "title", "words", "read_words", "verified_words"))


def page_units(owing: DataFrame, titles: DataFrame) -> DataFrame:
    """``doc_id, section, title, words, token_from, token_to, owes``: what every session of a document has as units, sections with words and the document (no section)."""
    own = owing.where("words > 0 AND NOT furniture").select("doc_id", "section", F.col("base").alias("title"), F.col("words").cast("long").alias("words"), "token_from", "token_to", "owes")
    whole = own.groupBy("doc_id").agg(F.sum("words").alias("words")).join(titles, "doc_id")
    return own.unionByName(whole.select("doc_id", F.lit(None).cast("int").alias("section"), "title", "words"), allowMissingColumns=True)


def of_topics(units: DataFrame, topics: DataFrame) -> DataFrame:
    """``units`` of readers or of pages whose title is a topic's, with the ``topic``. Each distinct title is normalised once; a title that most units have is dealt to parts."""
    # A key that can't be null asks for no check of nulls, which would be made on every row before the titles are distinct.
    key = F.coalesce(title_key(F.col("title")), F.lit(""))
    known = units.select("title").where("title IS NOT NULL").distinct().withColumn("topic", key).join(topics.select("topic"), "topic")
    return spread(units, known, ["title"], _session_of(units)).select("topic", *units.columns)


def _session_of(units: DataFrame) -> list[str]:
    return [c for c in SESSION if c in units.columns]


def exclusive(units: DataFrame, topics: DataFrame) -> DataFrame:
    """``units`` of readers or of pages whose title is a topic's, each topic counted once in a document: long sections beat the document, it beats short ones."""
    rows = of_topics(units, topics)
    same = Window.partitionBy(*_session_of(units), "topic")
    long = F.max(F.col("section").isNotNull() & (F.col("words") >= STOP_WORDS)).over(same)
    whole = F.max(F.col("section").isNull()).over(same)
    rows = rows.withColumn("long", long).withColumn("whole", whole)
    return rows.where(F.when(F.col("section").isNull(), ~F.col("long")).otherwise(F.col("long") | ~F.col("whole"))).drop("long", "whole")


def profiles(sessions: DataFrame, windows: DataFrame, summaries: DataFrame) -> DataFrame:
    """``doc_id, caret, windows, given, n``: how many sessions of a document came to one word with the same checks and summaries, one row a session in ``sessions``."""
    checks = windows.where("reader IS NOT NULL AND to > from").select(*SESSION, F.struct("from", "to").alias("window"))
    rows = sessions.select(*SESSION, "caret", F.lit(True).alias("heard")).unionByName(checks, allowMissingColumns=True)
    rows = rows.unionByName(summaries.where("reader IS NOT NULL").select(*SESSION, "section"), allowMissingColumns=True)
    lists = F.sort_array(F.collect_set("window")).alias("windows"), F.sort_array(F.collect_set("section")).alias("given")
    # No check or summary belongs to the sessions of readers without a number.
    known = rows.groupBy(*SESSION).agg(F.max("caret").alias("caret"), F.max("heard").alias("heard"), *lists).where("heard")
    return known.groupBy("doc_id", "caret", "windows", "given").agg(F.count(F.lit(1)).alias("n"))


def topic_words(kept: DataFrame, own: DataFrame, seen: DataFrame) -> DataFrame:
    """``topic, words, read_words, verified_words`` over all sessions: ``kept`` are pages' units that count for a topic, ``own`` their sections, ``seen`` the profiles.

    Which units a session has depends on the document only, so that topics are told before readers are met, and equal
    sessions are met once.
    """
    parts = kept.where("section IS NOT NULL").select("topic", *own.columns)
    whole = kept.where("section IS NULL").select("topic", "doc_id").join(own, "doc_id")
    rows = parts.unionByName(whole).join(seen.select("doc_id").distinct(), "doc_id", "left_semi")
    met = spread(seen, rows, ["doc_id"], ["caret", "windows", "given"])
    read = read_share(F.col("caret"), F.col("token_from"), F.col("token_to"))
    sat = F.exists("windows", lambda w: (w["to"] > F.col("token_from")) & (w["from"] < F.col("token_to")))
    verified = (read >= 1) & sat & (~F.col("owes") | F.array_contains("given", F.col("section")))
    n, words = F.col("n"), F.col("words")
    return met.select("topic", (n * words).alias("words"), (n * half_up(words * F.round(read, 6))).alias("read_words"), F.when(verified, n * words).otherwise(0).alias("verified_words"))


def topic_coverage(kept: DataFrame, topics: DataFrame) -> DataFrame:
    """``topic, groups, words, read_words, verified_words, state`` of every topic."""
    sums = kept.groupBy("topic").agg(*(F.sum(c).alias(c) for c in ("words", "read_words", "verified_words")))
    rows = topics.join(sums, "topic", "left").na.fill(0, ["words", "read_words", "verified_words"])
    w, r, v = F.col("words"), F.col("read_words"), F.col("verified_words")
    state = F.when(w == 0, "absent").when(r == 0, "unread").when(v >= w, "verified").when(v > 0, "partial").otherwise("unchecked")
    return rows.select("topic", "groups", "words", "read_words", "verified_words", state.alias("state"))


def group_coverage(covered: DataFrame) -> DataFrame:
    """``grp, topics, absent, unread, unchecked, partial, verified`` of each group of topics."""
    rows = covered.select(F.explode("groups").alias("grp"), "state")
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("topics"), *(F.count_if(F.col("state") == s).alias(s) for s in ("absent", "unread", "unchecked", "partial", "verified")))
