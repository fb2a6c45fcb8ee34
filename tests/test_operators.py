import datetime

import pytest
from pyspark.sql import functions as F

from lectern.functions import expr
from lectern.operators import coverage, library, reading, review, structure, text, vocab


def docs(spark, *texts):
    rows = [(i, t, "en", "s", f"title {i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, title string")


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_sentences_keep_abbreviations_together(spark):
    got = [r.sentence for r in structure.sentences(text.blocks(docs(spark, 'We met Dr. Smith. He left! "Why?" Nobody knew, e.g. us.')), "line").orderBy("at").collect()]
    assert got == ["We met Dr. Smith.", "He left!", '"Why?"', "Nobody knew, e.g. us."]


def test_sections_cut_at_the_block_that_reaches_the_stretch(spark):
    got = text.sections(docs(spark, "\n".join(["w " * 300] * 5))).orderBy("part").collect()
    assert [(r.part, r.first_block, r.n_blocks, r.words, r.stops) for r in got] == [(1, 0, 3, 900, True), (2, 3, 2, 600, True)]


def test_phrase_occurrences_do_not_overlap(spark):
    got = vocab.phrase_hits(docs(spark, "a a a a a b", "A, a.\nnothing"), "a a").orderBy("doc_id").collect()
    assert [(r.doc_id, r.hits) for r in got] == [(0, 2), (1, 1)]


@pytest.mark.parametrize("word,key", [("phone", "fn"), ("back", "bk"), ("city", "sty"), ("exit", "ekst"), ("eCRF", "ekrf"), ("letter", "ltr"), ("", "")])
def test_sound_key(spark, word, key):
    assert one(spark, expr.sound_key(F.lit(word))) == key


def test_fnv1a(spark):
    assert one(spark, expr.fnv1a(F.lit("a"))) == 0xE40C292C
    assert one(spark, expr.fnv1a(F.lit("foobar"))) == 0xBF9CF968


def test_review_state_folds_answers_in_order_of_time(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(days=i), 1, 5, q) for i, q in enumerate([3, 2, 2, 0, 1])]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, reader long, item int, quality int")
    r = review.review_state(log).first()
    assert (r.reps, r.lapses, r.days, r.ease) == (1, 1, 1, 1.7)


def test_no_interval_passes_the_horizon(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(days=i), 1, i % 3, (i * 7) % 4) for i in range(60)]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, reader long, item int, quality int")
    assert review.review_state(log, 5).where("days > 5").count() == 0


def test_restore_keeps_the_local_row_on_a_tie(spark):
    a = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 5)], "k int, v string, u int")
    b = spark.createDataFrame([(2, "b", 5), (3, "b", 6), (4, "b", 1)], "k int, v string, u int")
    got = {r.k: (r.v, r.action) for r in library.restore_merge(a, b, ["k"], "u").collect()}
    assert got == {1: ("a", "kept"), 2: ("a", "kept"), 3: ("b", "updated"), 4: ("b", "added")}


def test_pace_fit_goes_through_the_origin_without_a_slope(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, t, 1, 10, 100, 30000), (2, t, 1, 12, 90, 30000), (3, t, 2, 10, 100, 30000), (4, t, 2, 12, 120, 30000)]
    got = {r.voice: r for r in reading.pace_fit(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, voice long, tenths int, words long, ms long")).collect()}
    assert got[1].intercept == 0 and got[2].intercept == pytest.approx(0) and got[2].slope == pytest.approx(200)


def test_item_state_stream_equals_the_batch_fold(spark, tmp_path):
    from lectern.streaming import readers

    t = datetime.datetime(2024, 1, 1)
    rows = [(i, t + datetime.timedelta(hours=i), i % 4, i % 3, (i * 5) % 4) for i in range(200)]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp, reader long, item int, quality int")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = readers.settled(readers.item_state(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))), "update")
    got = {(r.reader, r.item): (r.ease, r.reps, r.lapses) for r in out.collect()}
    assert got == {(r.reader, r.item): (r.ease, r.reps, r.lapses) for r in review.review_state(log).collect()}


def test_capped_sentences(spark):
    long = "word " * 20 + "and then, " + "word " * 30 + "end"
    got = spark.createDataFrame([(long,), ("short one.",), ("x" * 400,)], "s string").select(structure.capped(F.col("s")).alias("p")).collect()
    assert got[0].p[0] == ("word " * 20 + "and then,") and " ".join(got[0].p) == long and all(len(x) <= 180 for x in got[0].p)
    assert got[1].p == ["short one."] and [len(x) for x in got[2].p] == [180, 180, 40]


def test_sections_of_marked_text(spark):
    text = "intro words here\n\n# One\n\n" + "a b c d e " * 80 + "\n\n- item\n1. first\n\n" + "f g h " * 150 + "\n\nlast\n\n## References\n\nx y"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = structure.blocks(d).orderBy("block").collect()
    assert [x.kind for x in b] == ["p", "h1", "p", "li", "li", "p", "p", "h2", "p"]
    s = structure.sections(structure.blocks(d)).orderBy("section").collect()
    assert [(x.title, x.level, x.part) for x in s] == [("Opening", 0, None), ("One", 1, 1), ("One (part 2)", 2, 2), ("References", 2, None)]
    assert s[3].furniture and not s[3].intercept and s[1].intercept and s[-1].token_to == sum(x.words for x in b)


def test_read_share_and_ladder(spark):
    share = spark.range(1).select(*(coverage.read_share(F.lit(c), F.lit(0), F.lit(10)).alias(f"c{c + 1}") for c in (-1, 4, 9))).first()
    assert list(share) == [0.0, 0.5, 1.0]
    heard = spark.createDataFrame([(1, i, 100 * (i + 1), i // 3) for i in range(9)], "doc_id long, chunk int, stop long, section int")
    owing = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, False)], "doc_id long, section int, owes boolean")
    got = [(r.chunk, r.event) for r in coverage.ladder(heard, owing).orderBy("chunk").collect()]
    assert got == [(2, "summary"), (3, "cloze"), (6, "cloze")]


def test_phrases_take_the_last_word_in_other_forms_and_stay_in_a_sentence(spark):
    texts = ("See the data plan. Data plans help, a (data) plan too", "Plan of data. Plan it.", "data planes and plan data", "the data. Plan")
    got = [(r.doc_id, r.line, r.hits) for r in vocab.phrase_hits(docs(spark, *texts), "data plan").orderBy("doc_id", "block", "at").collect()]
    assert got == [(0, "See the data plan.", 1), (0, "Data plans help, a (data) plan too", 2), (2, "data planes and plan data", 1)]
    assert vocab.phrase_hits(docs(spark, "Plans, plan; plane"), "plan").first().hits == 2


def test_headings_of_pages_keep_their_titles(spark):
    from lectern.sources import tables

    html = '<h1 id=a>One</h1><H2 class="x">Two words</H2><p>text</p><p><b>Three<br><h3>Four</h3><LI>item'
    got = structure.kinds(spark.createDataFrame([(1, html)], "doc_id long, html string").withColumn("text", tables.marked(F.col("html")))).where("kind <> 'blank'").orderBy("at").collect()
    assert [(x.kind, x.body) for x in got] == [("h1", "One"), ("h2", "Two words"), ("p", "text"), ("h2", "Three"), ("h3", "Four"), ("li", "item")]


def test_a_title_of_most_units_is_dealt_to_parts(spark):
    """Every reader's unit of one title meets its topic, in more than one part, and titles are normalised after they are distinct."""
    units = spark.range(400).selectExpr("id AS reader", "id % 3 AS doc_id", "cast(id % 2 AS int) AS section", "CASE WHEN id % 50 = 7 THEN NULL WHEN id % 50 = 9 THEN 'Other' ELSE 'The Plan' END AS title")
    topics = spark.createDataFrame([("plan",), ("",), ("none",)], "topic string")
    got = coverage.of_topics(units, topics)
    assert got.columns == ["topic", *units.columns] and got.count() == 384 and {r.topic for r in got.collect()} == {"plan"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan and not any("Filter" in x and "regexp_replace" in x for x in plan.splitlines())


def test_topics_are_told_before_readers_are_met(spark):
    """Equal sessions are one profile, and the words of topics are those of all readers' units, without a row for each reader's section."""
    sections = [(d, k, title, level, None, a, b, b - a, title == "References", True) for d in (1, 2) for k, (title, level, a, b) in enumerate((("One", 1, 0, 300), ("Two", 2, 300, 320), ("One", 2, 320, 640), ("References", 2, 640, 700)))]
    cols = "doc_id long, section int, base string, level int, part int, token_from int, token_to int, words int, furniture boolean, owes boolean"
    owing = spark.createDataFrame(sections, cols).withColumn("owes", F.col("section") == 0)
    sessions = spark.createDataFrame([(r, 1 + r % 2, (r % 4) * 160 + 200) for r in range(200)] + [(None, 1, 700), (None, 2, None)], "reader long, doc_id long, caret int")
    windows = spark.createDataFrame([(r, 1 + r % 2, a, a + 250, 3, 1) for r in range(0, 200, 3) for a in (0, 250)] + [(None, 1, 0, 250, 3, 1), (900, 1, 0, 250, 3, 1)], "reader long, doc_id long, from int, to int, blanks int, recalled int")
    given = spark.createDataFrame([(r, 1 + r % 2, 0) for r in range(0, 200, 5)] + [(None, 1, 0)], "reader long, doc_id long, section int")
    titles = owing.where("level = 1").groupBy("doc_id").agg(F.min_by("base", "section").alias("title"))
    topics = spark.createDataFrame([("one", [1]), ("two", [1]), ("references", [1]), ("other", [2])], "topic string, groups array<int>")
    units = coverage.units(coverage.section_coverage(sessions, owing, windows, given), titles)
    want = sorted(coverage.topic_coverage(coverage.exclusive(units, topics), topics).collect())
    pages, seen = coverage.page_units(owing, titles), coverage.profiles(sessions, windows, given)
    assert seen.agg(F.sum("n")).first()[0] == 202 and seen.count() < 40
    rows = coverage.topic_words(coverage.exclusive(pages, topics), pages.where("section IS NOT NULL").drop("title"), seen)
    assert sorted(coverage.topic_coverage(rows, topics).collect()) == want and {r.state for r in want} == {"absent", "partial"}
    assert rows.count() < 40 * 6
