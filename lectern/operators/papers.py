"""Recall questions over numbered words: candidates, carriers, checks, pools of questions, papers and drills.

Everything is kept per window of a document or per document, whose sizes are bounded by the document; the pool and the
paper are ranked by windows over documents and kinds, never in one task, but for the report of the paper itself.
"""

from __future__ import annotations

import collections
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.expr import answer_key, fnv1a, slug
from lectern.operators import library
from lectern.operators.questions import STOPWORDS
from lectern.operators.vocab import dictionary

#: Words of a window; what a term that is fully stuck adds to its score; blanks of a check, at least and at most.
WINDOW, WEAK_BOOST, MOST_BLANKS, LEAST_BLANKS = 250, 6, 3, 2

#: Words that a carrier has at least; questions of a kind from one document; options of a question; questions of a paper.
CARRIER_WORDS, PER_DOC, OPTIONS, PAPER = 6, 12, 4, 40

#: What stands for the answer, scores of terms, the share of a paper that each kind aims at.
BLANK = "____"
ACRONYM_SCORE, CAPITALS_SCORE, NUMBER_SCORE, NAME_SCORE = 10, 5, 4, 3
MIX = {"acronym": 0.35, "cloze": 0.45, "grid": 0.2}

#: What a word that may be asked about holds.
ASKED = "[A-Z0-9]"

#: Kinds of blocks that are not asked about, and the words that make the number after them a reference.
NOT_ASKED = ("table", "code", "h1", "h2", "h3")
REFERENCE = r"(?i)\b(sections?|sec|parts?|chapters?|appendix|annex|figures?|tables?|clauses?|paragraphs?|items?|steps?|volumes?|pages?)\.?\s*$"


def tagged(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``acronym``, the key of the dictionary that a word's ``core`` stands for."""
    known = dictionary(tokens.sparkSession)
    forms = known.select(F.col("key").alias("acronym"), F.explode(F.array("key", F.concat("key", F.lit("s")), F.concat("key", F.lit("'s")), F.concat("key", F.lit("’s")))).alias("core"))
    return tokens.join(F.broadcast(forms), "core", "left")  # a fixed small table


def salience(rows: DataFrame) -> DataFrame:
    """Tagged words that are worth asking, with ``score`` and ``key``: acronyms, capitals, numbers, names inside a sentence."""
    core = F.col("core")
    score = (
        F.when(F.col("acronym").isNotNull(), ACRONYM_SCORE).when(F.col("word").contains("["), 0).when(core.rlike("[0-9]") & (F.length(core) >= 2), NUMBER_SCORE)
        .when((F.col("at") == 0) | F.lower(core).isin(*STOPWORDS), 0).when(core.rlike("^[A-Z]{2,}$"), CAPITALS_SCORE).when(core.rlike("^[A-Z][a-z]{3,}$"), NAME_SCORE).otherwise(0)
    )
    rows = rows.where((core != "") & ~F.col("kind").isin(*NOT_ASKED)).withColumn("score", score).where("score > 0")
    return rows.withColumn("key", F.coalesce("acronym", slug(core)))


def candidates(rows: DataFrame, weak: DataFrame, lengths: DataFrame) -> DataFrame:
    """``doc_id, win, key, score, times, first``: terms of each full window; a stuck term gains once, not for each occurrence."""
    full = salience(rows).withColumn("win", F.floor(F.col("i") / WINDOW)).join(lengths, "doc_id").where((F.col("win") + 1) * WINDOW <= F.col("n_words"))
    by = full.groupBy("doc_id", "win", "key").agg(F.sum("score").alias("own"), F.count(F.lit(1)).alias("times"), F.min("i").alias("first"))
    out = by.join(weak, "key", "left")
    return out.select("doc_id", "win", "key", F.round(F.col("own") + WEAK_BOOST * F.coalesce("weight", F.lit(0.0)), 6).alias("score"), "times", "first")


def carriers(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id, i, chunk, key, answer, acronym, carrier``: occurrences whose sentence does not give the answer away."""
    own = salience(rows).select("doc_id", "i", "chunk", "at", "key", "core", "acronym", "word")
    held = own.join(chunks.where(F.col("n") >= CARRIER_WORDS).select("doc_id", "chunk", "text"), ["doc_id", "chunk"])
    before = F.array_join(F.slice(F.split("text", " "), F.lit(1), F.col("at")), " ")
    lead = F.length(before) + F.when(F.col("at") > 0, 1).otherwise(0) + F.length(F.regexp_extract("word", "^([^A-Za-z0-9]*)", 1))
    head, tail = F.substring("text", F.lit(1), lead), F.substring("text", lead + F.length("core") + 1, F.length("text"))
    out = held.withColumn("head", head).withColumn("carrier", F.concat("head", F.lit(BLANK), tail))
    reference = F.col("core").rlike("^[0-9][0-9.–-]*$") & F.col("head").rlike(REFERENCE)
    return out.where(~F.contains("carrier", F.col("core")) & ~reference).select("doc_id", "i", "chunk", "key", F.col("core").alias("answer"), "acronym", "carrier")


def checks(candidates: DataFrame, carriers: DataFrame) -> DataFrame:
    """``doc_id, win, i, chunk, key, answer, acronym, carrier``: up to three blanks of each window, one in a sentence, two at least.

    Candidates are taken best first, of equals the earlier one; the fold keeps the blanks chosen so far, three at most.
    """
    of = carriers.withColumn("win", F.floor(F.col("i") / WINDOW))
    found = of.groupBy("doc_id", "win", "key").agg(F.sort_array(F.collect_list(F.struct("i", "chunk", "answer", "acronym", "carrier"))).alias("places"))  # of one window
    ranked = candidates.join(found, ["doc_id", "win", "key"])
    ranked = ranked.groupBy("doc_id", "win").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("score"), "first", "key", "places"))).alias("c"))
    start = F.transform(F.slice(F.flatten(F.transform("c", lambda x: x["places"])), 1, 1), lambda p: F.struct(F.lit("").alias("key"), p.alias("p")))
    empty = F.slice(start, 1, 0)

    def step(s, x):
        free = F.filter(x["places"], lambda p: ~F.exists(s, lambda b: b["p"]["chunk"] == p["chunk"]))
        more = (F.size(s) < MOST_BLANKS) & (F.size(free) > 0)
        return F.when(more, F.concat(s, F.array(F.struct(x["key"].alias("key"), F.get(free, F.lit(0)).alias("p"))))).otherwise(s)

    picked = ranked.select("doc_id", "win", F.aggregate("c", empty, step).alias("b")).where(F.size("b") >= LEAST_BLANKS)
    return picked.select("doc_id", "win", F.explode("b").alias("b")).select("doc_id", "win", "b.p.i", "b.p.chunk", "b.key", "b.p.answer", "b.p.acronym", "b.p.carrier")


def _order(seed: str, key: Column) -> Column:
    return fnv1a(F.concat(F.lit(seed), key))


def cloze_questions(checks: DataFrame, seed: str) -> DataFrame:
    """``doc_id, id, kind, key, prompt, answer``: a term once in a document, its first blank; twelve of a document in seeded order."""
    meaning = F.lower(F.coalesce("acronym", "answer"))
    once = checks.withColumn("meaning", meaning).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "meaning").orderBy("i"))).where("k = 1")
    rows = once.withColumn("id", F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("cloze"), F.col("i").cast("string")))
    return _first(rows.withColumn("h", _order(seed + ":cloze", F.col("id")))).select("doc_id", "id", F.lit("cloze").alias("kind"), F.concat(F.lit("cloze:"), "meaning").alias("meaning"), F.col("carrier").alias("prompt"), "answer", "place")


def _first(rows: DataFrame, most: int = PER_DOC) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("h", "id"))).where(F.col("place") <= most)


def options(spark, seed: str) -> DataFrame:
    """``acronym, answer, options`` of the fixed small dictionary: distractors of the same category where there are three, else any."""
    words = dictionary(spark)
    a, b = words.alias("a"), words.alias("b")
    others = a.join(F.broadcast(b), F.col("a.key") != F.col("b.key")).select(F.col("a.key").alias("acronym"), F.col("a.expansion").alias("answer"), (F.col("a.category") == F.col("b.category")).alias("same"), F.col("b.key").alias("other"), F.col("b.expansion").alias("text"))
    n = F.sum(F.col("same").cast("int")).over(Window.partitionBy("acronym"))
    pool = others.withColumn("n", n).where((F.col("n") < OPTIONS - 1) | F.col("same")).where("text <> answer")
    pool = pool.withColumn("h", fnv1a(F.concat(F.lit(seed), "acronym", "other")))
    taken = pool.withColumn("k", F.row_number().over(Window.partitionBy("acronym").orderBy("h", "other"))).where(F.col("k") < OPTIONS)
    rows = taken.groupBy("acronym", "answer").agg(F.collect_list("text").alias("texts")).where(F.size("texts") == OPTIONS - 1)
    shown = F.array_sort(F.transform(F.concat(F.array("answer"), "texts"), lambda t: F.struct(fnv1a(F.concat(F.lit(seed), F.col("acronym"), F.lit(":opt"), t)).alias("h"), t.alias("t"))))
    return rows.select("acronym", "answer", F.transform(shown, lambda x: x["t"]).alias("options"))


def acronym_questions(rows: DataFrame, seed: str, most: int | None = PER_DOC) -> DataFrame:
    """``doc_id, id, kind, meaning, prompt, answer, options``: what each acronym of a document stands for, in seeded order."""
    used = rows.where("acronym IS NOT NULL").select("doc_id", "acronym").distinct().join(F.broadcast(options(rows.sparkSession, seed)), "acronym")
    out = used.withColumn("id", F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("acronym"), "acronym")).withColumn("h", _order(seed + ":acr", F.col("acronym")))
    out = _first(out, most or 1 << 30)
    return out.select("doc_id", "id", F.lit("acronym").alias("kind"), F.concat(F.lit("acr:"), "acronym").alias("meaning"), F.concat(F.lit("What does "), "acronym", F.lit(" stand for?")).alias("prompt"), "answer", "options", "place")


def question_pool(cloze: DataFrame, acronym: DataFrame) -> DataFrame:
    """``doc_id, id, kind, meaning, prompt, answer, place``: the questions of every document, by kind and place in it."""
    columns = ["doc_id", "id", "kind", "meaning", "prompt", "answer", "place"]
    return cloze.select(columns).unionByName(acronym.select(columns))


def assembled(pools: list[tuple[object, dict[str, list[tuple[str, str]]]]], count: int, picks: list, rest: bool = True) -> list:
    """Adds to ``picks`` (document, kind, id, meaning) from pools in order: one question of a document at a time, of the kind furthest below its share that it can still offer, no meaning twice; ``rest``: round after round.

    A pool's questions are ``(id, meaning)`` by kind, in its own order.
    """
    asked, taken = {p[3] for p in picks}, collections.Counter(p[1] for p in picks)
    going = True
    while going and len(picks) < count:
        going = False
        for doc, questions in pools:
            if len(picks) >= count:
                break
            best = None
            for kind, share in MIX.items():
                first = next((q for q in questions.get(kind, ()) if q[1] not in asked), None)
                debt = share * (len(picks) + 1) - taken[kind]
                if first and (best is None or debt > best[0]):
                    best = debt, kind, first
            if best:
                picks.append((doc, best[1], *best[2]))
                asked.add(best[2][1])
                taken[best[1]] += 1
                going = rest
    return picks


def paper(pool: DataFrame, seed: str, count: int = PAPER) -> DataFrame:
    """``place, id, kind, doc_id``: a paper of ``count`` questions, documents in turn by seeded order, no fact twice.

    The first round needs, after the documents that it has met, the next ones with a fact that is not asked yet: at most
    ``count`` documents with ``2 * count`` questions a kind are fetched at a time, and each time one at least is asked.
    A document that is met in a later round was met in the first, as what was asked stays asked. ``place`` counts the
    questions of a document and kind.
    """
    rows = library.kept(pool.where(F.col("place") <= 2 * count).select("doc_id", "id", "kind", "meaning", "place", _order(seed + ":docs", F.col("doc_id").cast("string")).alias("h")))
    picks, met, last = [], [], None
    while len(picks) < count:
        ahead = rows if last is None else rows.where((F.col("h") > last[0]) | ((F.col("h") == last[0]) & (F.col("doc_id") > last[1])))
        ahead = ahead.where(~F.col("meaning").isin(*(p[3] for p in picks))) if picks else ahead
        docs = ahead.select("h", "doc_id").distinct().orderBy("h", "doc_id").limit(count - len(picks))
        found = sorted(rows.join(F.broadcast(docs), ["h", "doc_id"]).collect(), key=lambda r: (r.h, r.doc_id, r.kind, r.place))
        if not found:
            break
        last = found[-1].h, found[-1].doc_id
        pools = [(doc, {k: [(r.id, r.meaning) for r in v] for k, v in itertools.groupby(list(g), key=lambda r: r.kind)}) for (_, doc), g in itertools.groupby(found, key=lambda r: (r.h, r.doc_id))]
        assembled(pools, count, picks, rest=False)
        met += pools
    assembled(met, count, picks)
    return pool.sparkSession.createDataFrame([(i, p[2], p[1], p[0]) for i, p in enumerate(picks, 1)], f"place int, id string, kind string, doc_id {pool.schema['doc_id'].dataType.simpleString()}")


def drill(questions: DataFrame, weak: DataFrame, seed: str) -> DataFrame:
    """``place, acronym, answer, weight``: every acronym that is used, once, the hardest first; as many rows as the dictionary has."""
    used = questions.select(F.substring("meaning", 5, 100).alias("acronym"), "answer").distinct()
    rows = used.join(weak.select(F.col("key").alias("acronym"), "weight"), "acronym", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("weight").desc(), _order(seed + ":drill", F.col("acronym")), "acronym"))).select("place", "acronym", "answer", "weight")


def matches(given: Column, expected: Column, expansion: Column) -> Column:
    """Whether a typed answer is the expected one after normalisation, or its acronym written out."""
    a = answer_key(F.coalesce(given, F.lit("")))
    return (a != "") & ((a == answer_key(expected)) | F.coalesce(a == answer_key(F.regexp_replace(expansion, "(?i)^the ", "")), F.lit(False)))
