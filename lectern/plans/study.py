"""Queries over structure, coverage, questions and papers, each with SQL that says the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.expr import fnv1a, slug, title_key
from lectern.operators import coverage, entities, library, papers, review, structure, text, topics, vocab
from lectern.sources import tables as t

SEED, EXAM_DAY, NEEDLE = "lectern", "1998-06-01", "e"


# What the queries share -------------------------------------------------------------------------------------------


def _page_blocks(s: SparkSession, d: str) -> DataFrame:
    return structure.blocks(t.page_docs(s, d))


def _page_sections(s: SparkSession, d: str) -> DataFrame:
    return structure.sections(_page_blocks(s, d))


def _heard(s: SparkSession, d: str) -> DataFrame:
    """Sentences of pages with their section and whether that is furniture."""
    of = _page_sections(s, d).select("doc_id", "section", "furniture", F.explode(F.sequence("block_from", F.col("block_to") - 1)).alias("block"))
    return structure.chunks(_page_blocks(s, d)).join(of, ["doc_id", "block"])


def _page_words(s: SparkSession, d: str) -> DataFrame:
    return _page_blocks(s, d).groupBy("doc_id").agg(F.sum("words").alias("n_words"))


def _covered(s: SparkSession, d: str) -> DataFrame:
    return coverage.section_coverage(t.reader_sessions(s, d), structure.owing(_page_sections(s, d)), t.spot_checks(s, d), t.summaries(s, d))


def _titles(s: SparkSession, d: str) -> DataFrame:
    return _page_sections(s, d).where("level = 1").groupBy("doc_id").agg(F.min_by("base", "section").alias("title"))


class _Topics:
    """What the queries of topics share: sections, units and topics of pages, written once, and reading sessions."""

    def __init__(self, s: SparkSession, d: str):
        self.spark, self.sf_dir = s, d
        self.sections = library.kept(_page_sections(s, d))
        self.owing = structure.owing(self.sections)
        self.titles = self.sections.where("level = 1").groupBy("doc_id").agg(F.min_by("base", "section").alias("title"))
        # Headings of pages as topics, one for each normalised title; a page's group is its number by ten.
        rows = self.sections.where("level > 0 AND coalesce(part, 1) = 1").select(title_key(F.col("base")).alias("topic"), (F.col("doc_id") % 10).alias("g")).where("topic <> ''")
        self.topics = library.kept(rows.groupBy("topic").agg(F.sort_array(F.collect_set("g")).alias("groups")))

    def page_units(self) -> DataFrame:
        return library.kept(coverage.page_units(self.owing, self.titles))

    def matched(self) -> DataFrame:
        sessions = library.kept(t.reader_sessions(self.spark, self.sf_dir).select("reader", "doc_id"))
        own = coverage.of_topics(self.page_units(), self.topics).select("doc_id", "section", "topic", "words").join(sessions.select("doc_id").distinct(), "doc_id", "left_semi")
        return coverage.spread(sessions, own, ["doc_id"], ["reader"]).select("reader", "doc_id", "section", "topic", "words")

    def exclusive(self) -> DataFrame:
        s, d = self.spark, self.sf_dir
        covered = coverage.section_coverage(t.reader_sessions(s, d), self.owing, t.spot_checks(s, d), t.summaries(s, d))
        return coverage.exclusive(coverage.units(library.kept(covered), self.titles), self.topics)

    def states(self) -> DataFrame:
        s, d, units = self.spark, self.sf_dir, self.page_units()
        seen = library.kept(coverage.profiles(t.reader_sessions(s, d), t.spot_checks(s, d), t.summaries(s, d)))
        own = units.where("section IS NOT NULL").drop("title")
        return coverage.topic_coverage(coverage.topic_words(coverage.exclusive(units, self.topics), own, seen), self.topics)


def _units(s: SparkSession, d: str) -> DataFrame:
    return coverage.units(library.kept(_covered(s, d)), _titles(s, d))


def _doc_blocks(s: SparkSession, d: str) -> DataFrame:
    return structure.blocks(t.docs(s, d))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return structure.chunks(_doc_blocks(s, d))


def _tagged(s: SparkSession, d: str) -> DataFrame:
    return papers.tagged(structure.tokens(_chunks(s, d)))


class _Words:
    """What questions are made of, written once: sentences, and of their words those that may be asked."""

    def __init__(self, s: SparkSession, d: str):
        self.chunks = library.kept(_chunks(s, d))
        # What may be asked holds a capital or a digit, as the dictionary's keys do.
        some = self.chunks.where(F.col("text").rlike(papers.ASKED))
        self.rows = library.kept(papers.tagged(structure.tokens(some, like=papers.ASKED)).where(F.col("acronym").isNotNull() | F.col("core").rlike(papers.ASKED)))
        self.spark, self.sf_dir = s, d

    def weak(self, keys: DataFrame) -> DataFrame:
        """``key, weight`` of terms: a term is the item that its hash names, as items are numbered in the answers."""
        items = review.weak_terms(review.review_state(t.answers(self.spark, self.sf_dir)))
        return keys.select("key").distinct().withColumn("item", (fnv1a(F.col("key")) % 7).cast("int")).join(F.broadcast(items), "item").select("key", "weight")  # seven items

    def candidates(self) -> DataFrame:
        lengths = self.chunks.groupBy("doc_id").agg(F.max("stop").alias("n_words"))
        return papers.candidates(self.rows, self.weak(papers.salience(self.rows)), lengths)

    def carriers(self) -> DataFrame:
        return papers.carriers(self.rows, self.chunks)

    def checks(self) -> DataFrame:
        return papers.checks(self.candidates(), self.carriers())

    def cloze(self) -> DataFrame:
        return papers.cloze_questions(self.checks(), SEED)

    def acronym(self, most: int | None = papers.PER_DOC) -> DataFrame:
        return papers.acronym_questions(self.rows, SEED, most)

    def pool(self) -> DataFrame:
        return papers.question_pool(self.cloze(), self.acronym())


def _item_ids(s: SparkSession, d: str) -> DataFrame:
    """``doc_id, item``: what each cloze question and each acronym of a document is remembered under."""
    words = _Words(s, d)
    own = F.col("doc_id").cast("string")
    cloze = words.cloze().select("doc_id", F.concat(own, F.lit(":cloze:"), slug(F.col("answer"))).alias("item"))
    short = papers.salience(words.rows).where("acronym IS NOT NULL").select("doc_id", F.concat(own, F.lit(":acr:"), "acronym").alias("item"))
    return cloze.unionByName(short).distinct()


def _drill(s: SparkSession, d: str) -> DataFrame:
    words = _Words(s, d)
    found = words.acronym(None)
    return papers.drill(found, words.weak(found.select(F.substring("meaning", 5, 100).alias("key"))), SEED)


def _marked(s: SparkSession, d: str) -> DataFrame:
    """Every check answered by what its window asks next: right where two blanks have one answer or stand for it."""
    from pyspark.sql import Window

    words = vocab.dictionary(s).select(F.col("key").alias("acronym"), "expansion")
    rows = _Words(s, d).checks().join(F.broadcast(words), "acronym", "left")
    given = F.lead("answer").over(Window.partitionBy("doc_id", "key").orderBy("i"))
    spoken = F.when(F.col("i") % 2 == 0, F.coalesce("expansion", F.upper("answer"))).otherwise(given)
    return rows.withColumn("given", spoken).select("doc_id", "i", "given", papers.matches(F.col("given"), F.col("answer"), F.col("expansion")).alias("right"))


def _wpm(s: SparkSession, d: str) -> DataFrame:
    """``reader, wpm``: pace by events and active time, else the baseline, in steps of five."""
    from lectern.operators import reading

    rows = reading.active_time(t.table(s, d, "events"))
    pace = F.col("events") * 40 / (F.col("active_ms") / 60000)
    return rows.select("reader", (F.floor(F.when((F.col("events") > 25) & (F.col("active_ms") > 4000), pace).otherwise(F.lit(185)) / 5 + 0.5) * 5).cast("long").alias("wpm"))


def _readiness(s: SparkSession, d: str) -> DataFrame:
    """``reader, due, items, mean3, cap_days`` for an exam in thirty days after the log's end."""
    from lectern.plans.registry import NOW

    queue = review.due_counts(review.review_state(t.answers(s, d)), NOW)
    trend = review.paper_trend(t.paper_answers(s, d)).select("reader", "mean3")
    left = F.datediff(F.lit("2024-03-02").cast("date"), F.to_date(F.lit(NOW)))
    return queue.join(trend, "reader", "left").select("reader", left.alias("days_left"), "due", "items", "mean3", F.greatest(F.lit(1), F.floor(left / 2)).cast("int").alias("cap_days"))


class _Located:
    """Sentences of documents in their sections, of which names, acronyms and their rivals in lower case are found.

    Texts are dealt by document once; sentences in their sections are written, and each step takes from them the words
    that it needs, chosen before a word becomes a row.
    """

    WHERE = ("section", "furniture")

    def __init__(self, s: SparkSession, d: str):
        parts = int(s.conf.get("spark.sql.shuffle.partitions"))  # as few as the bytes of the texts ask for would be too few for this much work
        blocks = structure.blocks(t.docs(s, d).select("doc_id", "text").repartition(parts, "doc_id"))
        self.chunks = library.kept(structure.chunks(structure.seated(blocks), *self.WHERE))
        # A sentence without a capital after its first word names nothing; one of as many words as may join a name could stand inside one.
        naming = self.chunks.where(F.col("text").rlike(entities.NAMED) | (F.col("n") <= entities.MOST_CONNECTORS))
        self.named = papers.tagged(structure.tokens(naming, *self.WHERE, like=entities.NAMING))
        self.short = papers.tagged(structure.tokens(self.chunks.where(F.col("text").rlike("[A-Z]")), *self.WHERE, like="[A-Z]")).where("acronym IS NOT NULL")  # keys have capitals
        self.lower = papers.tagged(structure.lower_words(self.chunks, *self.WHERE))

    def mentions(self) -> DataFrame:
        return entities.mentions(self.named, self.short)

    def index(self) -> DataFrame:
        return entities.document_index(self.named, self.short, self.lower)


def _index(s: SparkSession, d: str) -> DataFrame:
    return _Located(s, d).index()


def _anchored(s: SparkSession, d: str) -> DataFrame:
    rows = _Located(s, d)
    return entities.anchors(rows.short, rows.index())


def _corpus(s: SparkSession, d: str) -> DataFrame:
    """For the queries whose SQL lists an entity's documents up to a thousand."""
    return entities.corpus_index(library.kept(_index(s, d)), entities.LISTED)


def _told_corpus(corpus: DataFrame) -> DataFrame:
    """The listed documents as text, for comparing."""
    one = lambda x: F.concat_ws(":", x["doc_id"], x["count"], x["first"], x["sections"])
    return corpus.withColumn("listed", F.array_join(F.transform("listed", one), ","))


def _line_blocks(s: SparkSession, d: str) -> DataFrame:
    """Lines of documents as blocks of prose."""
    from pyspark.sql import Window

    rows = text.blocks(t.docs(s, d)).select("doc_id", "block", F.lit("p").alias("kind"), F.col("line").alias("text"), F.size(F.filter(F.split("line", " "), lambda w: w != "")).alias("words"))
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))


def _exported(s: SparkSession, d: str) -> DataFrame:
    """The library as written to a snapshot and read back: sources only, blank ones dropped."""
    rows = t.table(s, d, "documents").where(F.coalesce("text", F.lit("")).rlike(r"\S")).select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))
    folder = library.export({"docs": rows, "labels": t.table(s, d, "labels")})
    return s.read.parquet(f"{folder}/docs")


FORMS = "th"


def _forms(s: SparkSession, d: str) -> DataFrame:
    """``item_id, words, forms``: benchmark titles as phrases, and the forms that the last word may take."""
    title = F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0))
    words = F.filter(F.transform(F.split(title, r"\s+"), lambda w: F.regexp_extract(w, vocab.CORE, 1)), lambda w: w != "")
    rows = t.table(s, d, "benchmark").select("item_id", words.alias("w")).where(F.size("w") > 0)
    return rows.select("item_id", F.array_join("w", " ").alias("words"), F.array_join(F.array_sort(vocab.final_forms(F.element_at("w", -1))), " ").alias("forms"))


def _report(name: str, rows: list[tuple[str, DataFrame, int | None]]) -> DataFrame:
    """``report, check, value, ok`` of one-row counts; without an expected value, any number above none is right."""
    made = [df.select(F.lit(name).alias("report"), F.lit(check).alias("check"), F.col("value").cast("long").alias("value"), (F.col("value") == want if want is not None else F.col("value") > 0).alias("ok")) for check, df, want in rows]
    return reduce(DataFrame.unionByName, made)


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("value"))


def _told(name: str, counts: list[tuple[DataFrame, dict[str, int | None]]]) -> DataFrame:
    """``report, check, value, ok`` of rows of counts, each counted in one pass; without an expected value, any number above none is right."""
    out = []
    for df, wanted in counts:
        one = lambda c, want: F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").cast("long").alias("value"), (F.col(f"`{c}`") == want if want is not None else F.col(f"`{c}`") > 0).alias("ok"))
        out.append(df.select(F.explode(F.array(*(one(c, w) for c, w in wanted.items()))).alias("x")).select(F.lit(name).alias("report"), "x.*"))
    return reduce(DataFrame.unionByName, out)


def _dq_checks(s: SparkSession, d: str) -> DataFrame:
    c = library.kept(_Words(s, d).checks())
    by = c.groupBy("doc_id", "win").agg(
        F.count_if(F.contains("carrier", F.col("answer"))).alias("left"), F.count_if(~F.contains("carrier", F.lit(papers.BLANK))).alias("none"), F.count(F.lit(1)).alias("n"), F.count_distinct("chunk").alias("chunks")
    )
    own = by.agg(F.sum("left").alias("answer left in its carrier"), F.sum("none").alias("no blank"), F.sum(F.col("n") - F.col("chunks")).alias("shared carrier"), F.count(F.lit(1)).alias("windows"))
    return _told("checks", [(own.na.fill(0), {"answer left in its carrier": 0, "no blank": 0, "shared carrier": 0, "windows": None})])


def _dq_paper(s: SparkSession, d: str) -> DataFrame:
    words = _Words(s, d)
    pool = library.kept(words.pool())
    a = words.acronym().agg(F.count_if(~F.array_contains("options", F.col("answer"))).alias("answer not among the options"))
    own = pool.agg(F.count_if(F.trim("prompt") == "").alias("empty prompt"))
    p = papers.paper(pool, SEED).agg((F.count(F.lit(1)) - F.count_distinct("id")).alias("one question twice"), F.count(F.lit(1)).alias("questions"))
    return _told("paper", [(a, {"answer not among the options": 0}), (own, {"empty prompt": 0}), (p, {"one question twice": 0, "questions": None})])


def _dq_coverage(s: SparkSession, d: str) -> DataFrame:
    """A reader who read all and passed all owes nothing; one who read nothing verified nothing."""
    own = structure.owing(_page_sections(s, d))
    ends = own.groupBy("doc_id").agg(F.max("token_to").alias("end"))
    one = lambda c: ends.select(F.lit(1).cast("long").alias("reader"), "doc_id", F.col(c) if isinstance(c, str) else c.alias("caret"))
    full = ends.select(F.lit(1).cast("long").alias("reader"), "doc_id", (F.col("end") - 1).alias("caret"), F.lit(0).alias("checked"))
    empty = ends.select(F.lit(1).cast("long").alias("reader"), "doc_id", F.lit(-1).alias("caret"), F.lit(0).alias("checked"))
    windows = ends.select(F.lit(1).cast("long").alias("reader"), "doc_id", F.lit(0).alias("from"), "end", F.lit(3).alias("blanks"), F.lit(3).alias("recalled")).withColumnRenamed("end", "to")
    given = own.select(F.lit(1).cast("long").alias("reader"), "doc_id", "section")
    best = coverage.section_coverage(full, own, windows, given)
    worst = coverage.section_coverage(empty, own, windows.where("blanks < 0"), given.where("section < 0"))
    return _report("coverage", [
        ("owed after a perfect reading", _count(best.where("words > 0 AND state <> 'verified'")), 0),
        ("verified after an empty reading", _count(worst.where("words > 0 AND state = 'verified'")), 0),
        ("sections", _count(own.where("words > 0")), None),
    ])


def _dq_topics(s: SparkSession, d: str) -> DataFrame:
    all_ = _Topics(s, d)
    twice = all_.exclusive().groupBy("reader", "doc_id", "topic").agg((F.max(F.col("section").isNull()) & F.max(F.col("section").isNotNull())).alias("both")).agg(F.count_if("both").alias("document and section counted both"))
    lost = all_.sections.agg(F.count_if((F.col("level") > 0) & (F.trim("base") == "")).alias("names lost to normalisation"))
    return _told("topics", [(twice, {"document and section counted both": 0}), (lost, {"names lost to normalisation": 0}), (all_.topics.agg(F.count(F.lit(1)).alias("topics")), {"topics": None})])


def _dq_phrases(s: SparkSession, d: str) -> DataFrame:
    from lectern.plans.registry import PHRASE

    sites = vocab.phrase_sites(t.docs(s, d), PHRASE)
    return _report("phrases", [
        ("quotation without the phrase", _count(sites.where(~F.lower("line").rlike("of[^a-z0-9]+the"))), 0),
        ("more quotations than allowed", _count(sites.where(F.col("rank") > vocab.QUOTATIONS)), 0),
        ("quotations", _count(sites), None),
    ])


def _dq_entities(s: SparkSession, d: str) -> DataFrame:
    """What the indexes must hold, counted in one pass over the documents' entries and one over the corpus."""
    index = library.kept(_index(s, d))
    name = F.col("kind") == "term"
    own = index.agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.trim("display") == "").alias("blank name"), F.count_if(name & (F.col("count") < entities.LEAST)).alias("below the floor"),
        F.count_if(F.size(F.split("display", " ")) > entities.LONGEST).alias("too long a name"), F.count_if(F.size("sections") == 0).alias("no section"), F.count_if(name & F.lower("display").isin(*entities.NOT_NAMES)).alias("names nothing"),
        F.sum(F.when(F.col("rank") == 1, F.col("truncated")).otherwise(0)).alias("truncated"),
    )
    merged = entities.corpus_index(index, entities.LISTED).agg(F.count_if(F.col("docs") >= 2).alias("shared"), F.count_if(F.size("listed") != F.col("docs")).alias("documents not listed"))
    told = lambda df: df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*(F.col(f"`{c}`").cast("long") for c in df.columns)))).alias("check", "value"))
    free = F.col("check").isin("entries", "shared", "truncated")
    return told(own).unionByName(told(merged)).select(F.lit("entities").alias("report"), "check", "value", (free | (F.col("value") == 0)).alias("ok"))


QUERIES = {
    "src_pages": lambda s, d: structure.kinds(t.page_docs(s, d)).where("kind <> 'blank'"),
    "snapshot_export": _exported,
    "block_kinds": lambda s, d: structure.kinds(t.page_docs(s, d)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars")),
    "paragraph_islands": _page_blocks,
    "section_of_block": lambda s, d: structure.placed(_page_blocks(s, d)).select("doc_id", "block", "seed", "title", "level"),
    "sections": _page_sections,
    "intercept_flag": lambda s, d: _page_sections(s, d).select("doc_id", "section", "level", "words", "intercept"),
    "demands_summary": lambda s, d: structure.owing(_page_sections(s, d)).select("doc_id", "section", "owes"),
    "content_words": lambda s, d: structure.content(_page_sections(s, d)).select("doc_id", "content_words"),
    "first_content": lambda s, d: structure.content(_page_sections(s, d)).select("doc_id", "first_token"),
    "fold_checkpoints": lambda s, d: structure.folded(structure.sections(_line_blocks(s, d))),
    "sentences": lambda s, d: structure.sentences(text.blocks(t.docs(s, d)), "line").select("doc_id", "block", F.col("at").alias("sentence"), F.col("sentence").alias("text")),
    "pacing_checkpoints": lambda s, d: structure.sections(_line_blocks(s, d)).select("doc_id", "section", "title", "part", "block_from", "block_to", "words"),
    "cap_length": _chunks,
    "bionic_split": lambda s, d: text.tokens(t.docs(s, d)).select("word").distinct().select("word", F.substring("word", F.lit(1), structure.lead_letters(F.col("word"))).alias("lead")),
    "entity_mentions": lambda s, d: _Located(s, d).mentions(),
    "entity_doc": lambda s, d: _index(s, d).withColumn("sections", F.array_join("sections", ",")),
    "entity_corpus": lambda s, d: entities.corpus_text(_index(s, d)),
    "entity_filter": lambda s, d: _told_corpus(entities.filtered(_corpus(s, d), vocab.dictionary(s), NEEDLE, shared=True)),
    "section_anchors": _anchored,
    "phrase_words": lambda s, d: _forms(s, d).select("item_id", "words"),
    "final_forms": lambda s, d: _forms(s, d).select("item_id", "forms"),
    "short_name": lambda s, d: t.table(s, d, "customer").select("c_custkey", vocab.short_name(F.concat(F.lit("Google "), F.col("c_mktsegment"), F.lit(" voice - "), F.col("c_name"))).alias("label")),
    "coverage_units": _units,
    "unit_exclusive": lambda s, d: _Topics(s, d).exclusive(),
    "topic_match": lambda s, d: _Topics(s, d).matched(),
    "topic_coverage": lambda s, d: _Topics(s, d).states().drop("groups"),
    "topic_gaps": lambda s, d: _Topics(s, d).states().where("state = 'absent'").select("topic"),
    "group_coverage": lambda s, d: coverage.group_coverage(_Topics(s, d).states()),
    "term_salience": lambda s, d: papers.salience(_Words(s, d).rows).select("doc_id", "i", "key", "core", "score"),
    "cloze_candidates": lambda s, d: _Words(s, d).candidates(),
    "cloze_windows": lambda s, d: _Words(s, d).candidates(),
    "cloze_carriers": lambda s, d: _Words(s, d).carriers(),
    "cloze_checks": lambda s, d: _Words(s, d).checks(),
    "acronym_questions": lambda s, d: _Words(s, d).acronym().withColumn("options", F.array_join("options", "|")),
    "cloze_questions": lambda s, d: _Words(s, d).cloze(),
    "item_ids": _item_ids,
    "question_pool": lambda s, d: _Words(s, d).pool(),
    "paper": lambda s, d: papers.paper(_Words(s, d).pool(), SEED),
    "drill": _drill,
    "mark_answers": _marked,
    "readiness": _readiness,
    "read_share": lambda s, d: t.reader_sessions(s, d).join(_page_words(s, d), "doc_id").select("reader", "doc_id", F.round(coverage.read_share(F.col("caret"), F.lit(0), F.col("n_words")), 6).alias("read")),
    "cloze_by_section": lambda s, d: coverage.cloze_by_section(t.spot_checks(s, d), _page_sections(s, d)),
    "section_coverage": _covered,
    "doc_coverage": lambda s, d: coverage.doc_coverage(_covered(s, d), t.spot_checks(s, d)),
    "state_words": lambda s, d: coverage.state_words(_covered(s, d)),
    "next_to_verify": lambda s, d: coverage.next_to_verify(_covered(s, d)),
    "next_stop": lambda s, d: coverage.next_stop(t.reader_sessions(s, d), _page_sections(s, d), t.summaries(s, d), _page_words(s, d)),
    "check_gauge": lambda s, d: coverage.check_gauge(t.reader_sessions(s, d), _heard(s, d), _page_words(s, d)),
    "active_block": lambda s, d: coverage.active_block(t.reader_sessions(s, d), _page_blocks(s, d)),
    "pre_roll": lambda s, d: coverage.pre_roll(t.reader_sessions(s, d), _heard(s, d)),
    "ladder_events": lambda s, d: coverage.ladder(_heard(s, d), structure.owing(_page_sections(s, d))),
    "effective_wpm": _wpm,
    "dq_entities": _dq_entities,
    "dq_checks": _dq_checks,
    "dq_paper": _dq_paper,
    "dq_coverage": _dq_coverage,
    "dq_topics": _dq_topics,
    "dq_phrases": _dq_phrases,
}
