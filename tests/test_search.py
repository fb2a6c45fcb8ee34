"""Outlines, dictated text, look-alike titles, records of a backup and names, against plain loops."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.functions import expr
from lectern.operators import dictation, entities, outline, papers, records, structure, topics
from lectern.plans import registry


def sections(spark, *rows):
    made = [(1, i, t, level, stop) for i, (level, t, stop) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, section int, base string, level int, intercept boolean")


def test_outline(spark):
    s = sections(spark, (0, "Book", False), (1, "Scope", True), (3, "Deep", False), (2, "Scope ", True), (3, "Introduction", True), (1, "Privacy", False), (2, "  privacy", True), (3, "Introduction", True), (1, "", False))
    got = outline.qualified(s).orderBy("section").collect()
    assert [x.chapter for x in got] == [None, "Book", "Scope", "Scope", "Scope ", "Book", "Privacy", "  privacy", "Book"]
    assert [x["name"] for x in got] == ["Book", "Book — Scope", "Scope — Deep", "Scope", "Scope — Introduction", "Book — Privacy", "privacy", "privacy — Introduction", "Book"]
    assert sorted(x.section for x in outline.search(s, " PRIVACY ").collect()) == [5, 6, 7]
    assert outline.search(s, "  ").count() == 9 and outline.search(s, "nothing").count() == 0
    a = outline.ambiguous(s).first()
    assert (a.stops, a.shared, a.titles, a.names) == (5, 2, 4, 5)


def spoken_back(transcript, vocabulary):
    """The rules read plainly, over words."""
    def key(text):
        t = re.sub("[^a-z]", "", text.lower()).replace("ph", "f").replace("ck", "k")
        t = re.sub("c(?=[eiy])", "s", t).translate(str.maketrans("cqz", "kks")).replace("x", "ks")
        out = ""
        for c in t:
            if (c in "aeiou" and out) or out.endswith(c):
                continue
            out += c
        return out

    size = lambda x: len(re.sub("[^A-Za-z]", "", x))
    keyed, written = {}, {}
    for term in sorted(vocabulary, key=lambda t: (-len(t), t)):
        for form in (term, " ".join(dictation.LETTERS[c] for c in re.sub("[^a-z]", "", term.lower()))):
            k = key(form)
            if len(k) >= 3 and keyed.setdefault(k, (term, []))[0] == term:
                keyed[k][1].append(size(form))
    for term in sorted(vocabulary):
        written[term.lower()] = term
    words, out, changes, i = transcript.split(), [], [], 0
    while i < len(words):
        for n in (4, 3, 2, 1):
            phrase = " ".join(words[i : i + n])
            if i + n > len(words) or not re.search("[A-Za-z]", phrase):
                continue
            found = written.get(phrase.lower()) if n == 1 else None
            if not found and key(phrase) in keyed and any(m * 0.6 <= size(phrase) <= m * 1.4 for m in keyed[key(phrase)][1]):
                found = keyed[key(phrase)][0]
            if found:
                changes += [(phrase, found)] * (phrase != found)
                out.append(found)
                i += n
                break
        else:
            out.append(words[i])
            i += 1
    return " ".join(out), changes


def test_dictated_text(spark):
    r = random.Random(2)
    vocabulary = {1: ["CDISC", "eCRF", "CRF", "SDTM", "Query", "QUERY", "EDC"], 2: ["CDISC"], 3: []}
    bits = "see disk uses e see are eff ess dee tee em query edc EDC, the of to cdisc. crf Query SDTM sdtm a dam 12 — so".split()
    texts = [" ".join(r.choice(bits) for _ in range(r.randrange(0, 30))) for _ in range(60)] + ["uses see disk", "", "  we\n use  see disk ", "ess dee tee em"]
    rows = [(i, i % 4, t) for i, t in enumerate(texts)] + [(900, 1, None)]
    terms = spark.createDataFrame([(s, t) for s, v in vocabulary.items() for t in v] + [(1, "CDISC"), (None, "CRF")], "scope int, term string")
    got = {x.id: (x.text, [(c["from"], c["to"]) for c in x.corrections]) for x in dictation.reconciled(spark.createDataFrame(rows, "id int, scope int, text string"), terms).collect()}
    assert got == {i: spoken_back(t or "", vocabulary.get(s, [])) for i, s, t in rows}
    assert sum(len(c) for _, c in got.values()) > 20


def test_spoken_forms(spark):
    rows = spark.createDataFrame([(1, 1, "the loink code")], "id int, scope int, text string")
    terms, spoken = spark.createDataFrame([(1, "LOINC")], "scope int, term string"), spark.createDataFrame([("LOINC", "loink")], "term string, form string")
    assert dictation.reconciled(rows, terms, spoken).first().text == "the LOINC code"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_misses(spark):
    r = random.Random(3)
    known = ["".join(r.choice("abc ") for _ in range(r.randrange(5, 16))).strip() for _ in range(60)]
    titles = list(known[:10]) + [""]
    for k in known:
        t = list(k)
        for _ in range(r.randrange(1, 4)):
            at = r.randrange(len(t) + 1)
            t[at : at + r.randrange(2)] = r.choice(["", "a", "z"])
        titles.append("".join(t))
    listed = titles[20:23]
    got = topics.near_misses(*(spark.createDataFrame([(x,) for x in v], f"{c} string") for v, c in ((titles, "title"), (known, "topic"), (listed, "title"))))
    want = {(t, k, edits(t, k)) for t in titles for k in known if len(t) >= 8 and t not in known and t not in listed and edits(t, k) <= 2}
    assert {tuple(x) for x in got.collect()} == want and len(want) > 20
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_resembling_titles(spark):
    listed = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "title string, topic string")
    got = topics.resembling(spark.createDataFrame([("a",), ("a",), ("c",)], "title string"), listed).collect()
    assert [tuple(x) for x in got] == [("a", ["x", "y"])]


def test_records(spark):
    rows = [
        ("docs", '{"id": "1", "title": "", "source": "x", "more": [1]}', None), ("docs", '{"id": "", "title": "t", "source": "x"}', "id: empty"), ("docs", '{"id": 1, "title": "t", "source": "x"}', "id: no text"),
        ("docs", '{"id": "1", "title": "t", "source": " \\n"}', "source: empty"), ("docs", '{"id": "1", "source": "x"}', "title: missing"), ("docs", '{"id": "1", "title": null, "source": "x"}', "title: no text"),
        ("sessions", '{"docId": "a", "tokenIndex": 1.5}', None), ("sessions", '{"docId": "a", "tokenIndex": "1"}', "tokenIndex: no number"), ("exams", '{"id": "a", "at": 1, "correct": 1, "total": 2, "missed": []}', None),
        ("exams", '{"id": "a", "at": 1, "correct": 1, "total": 2, "missed": {}}', "missed: no list"), ("reviews", '{"id": "", "docId": "", "prompt": "", "dueAt": 0}', None),
        ("docs", "{", "no JSON"), ("docs", None, "no JSON"), ("docs", "[1]", "no object"), ("docs", "null", "no object"), ("other", "{}", "kind not known"), (None, "{}", "kind not known"),
    ]
    got = records.validated(spark.createDataFrame(rows, "kind string, payload string, want string"))
    assert [(x.payload, x.reason) for x in got.collect() if x.reason != x.want] == []
    assert {(x.kind, x.reason): x.n for x in records.counted(got).collect()}[("docs", "good")] == 1


def names_of(spark, text):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = structure.blocks(d)
    return entities.located(papers.tagged(structure.tokens(structure.chunks(b))), structure.sections(b))


@pytest.mark.parametrize(
    "text,want",
    [
        ("we met the Department of Health and Human Services today", ["Department of Health and Human Services"]),
        ("both the Sponsor and the site agree, as Sponsor and the Investigator do", ["Sponsor", "Sponsor and the Investigator"]),
        ("from the Sponsor, the Investigator (Lead) and Monitor.", ["Sponsor", "Investigator Lead", "Monitor"]),
        ("Every start is plain. Sponsor first, then Sponsor second", ["Sponsor"]),
        ("a Plan of the of Care and in January a Table of Data", ["Plan", "Care", "Data"]),
        ("see One Aa Bb Cc Dd Ee Ff Gg Hh of Ii end", ["One Aa Bb Cc Dd Ee Ff Gg", "Hh of Ii"]),
        ("with Grade [A] and B and Xx", ["Grade", "Xx"]),
        ("the Office of THE Data of the", ["Office", "THE", "Data"]),
    ],
)
def test_mentions(spark, text, want):
    assert [x.display for x in entities.mentions(names_of(spark, text)).orderBy("i").collect()] == want


def test_document_and_corpus_index(spark):
    text = "so Sponsor met Sponsor and sponsor then. it is Data here, data there, our data and Data in data. the Data Plan, the Data Plan, THE end"
    got = {x.display: x for x in entities.document_index(names_of(spark, text)).collect()}
    assert {k: v["count"] for k, v in got.items()} == {"Sponsor": 2, "Data Plan": 2, "THE": 1} and got["THE"].kind == "acronym" and got["Sponsor"]["first"] == 1
    index = spark.createDataFrame([(1, "k", "Kay", "term", 2, 5, [0]), (2, "k", "KAY", "term", 9, 1, [0, 3]), (3, "k", "kAY", "term", 9, 1, [1]), (1, "z", "Z", "acronym", 1, 0, [0])], "doc_id long, key string, display string, kind string, count long, first long, sections array<int>")
    rows = {x.key: x for x in entities.corpus_index(index).collect()}
    assert (rows["k"].display, rows["k"].docs, rows["k"].total) == ("KAY", 3, 20) and [tuple(x) for x in rows["k"].listed] == [(2, 9, 1, 2), (3, 9, 1, 1), (1, 2, 5, 1)]
    acronyms = spark.createDataFrame([("z", "the zed")], "key string, expansion string")
    assert [x.key for x in entities.filtered(entities.corpus_index(index), acronyms, "ZED").collect()] == ["z"]
    assert [x.key for x in entities.filtered(entities.corpus_index(index), acronyms, "", shared=True, kind="term").collect()] == ["k"]


def test_corpus_lists_every_document_however_many(spark):
    r = random.Random(5)
    rows = [(d, "k", r.choice(["Kay", "KAY", "kAY"]), r.choice(["term", "acronym"]), r.choice([1, 2, 10, 300]), r.randrange(99), list(range(r.randrange(1, 13)))) for d in [*range(1001), *range(-2, 0), *range(4095, 9000, 7), 2**40]]
    rows += [(7, "z", "Z", "acronym", 1, 0, [0])]
    index = spark.createDataFrame(rows, "doc_id long, key string, display string, kind string, count long, first long, sections array<int>")
    for key in "kz":
        own = [x for x in rows if x[1] == key]
        busy = sorted(own, key=lambda x: (-x[4], x[0]))
        want = (busy[0][2], min(own)[3], len(own), sum(x[4] for x in own))
        list_, text = (f(index).where(f"key = '{key}'").first() for f in (entities.corpus_index, entities.corpus_text))
        assert (list_.display, list_.kind, list_.docs, list_.total) == (text.display, text.kind, text.docs, text.total) == want
        assert [tuple(x) for x in list_.listed] == [(x[0], x[4], x[5], len(x[6])) for x in busy]
        assert text.listed == ",".join(f"{x[0]}:{x[4]}:{x[5]}:{len(x[6])}" for x in busy)
    assert [x.listed is None for x in entities.corpus_index(index, entities.LISTED).orderBy("key").collect()] == [True, False]


def test_corpus_of_a_common_name_equals_its_sql(spark, tmp_path):
    texts = ["so THE end is THE same" if i % 3 else "so THE end. we met Ada Byron and Ada Byron" for i in range(1100)]
    spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = "key, display, kind, docs, total, listed"
    for name in ("entity_corpus", "entity_filter"):
        got = sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).select(*columns.split(", ")).collect()))
        assert got == sorted(c.execute(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})").fetchall())
        whole = {x[0]: x[5] and len(x[5].split(",")) for x in got}
        assert whole["THE"] == (1100 if name == "entity_corpus" else None)


def test_capped_sentences_are_cut_where_a_loop_cuts(spark):
    def parts(s):
        out, rest = [], s
        while len(rest) > 180:
            w = rest[:180]
            at = max(w.rfind(m) for m in ("; ", ", ", " — ", " – "))
            cut = at + 1 if at > 72 else w.rfind(" ") if w.rfind(" ") > 0 else 180
            out.append(rest[:cut].strip(" "))
            rest = rest[cut:].strip(" ")
        return [x for x in [*out, rest] if x]

    r = random.Random(8)
    texts = [r.choice(["", "x" * 200]) + "".join(r.choice([" ", " ", ", ", "; ", " — ", " – ", ",", ""]) + "é" * r.randrange(1, r.choice((6, 60, 190))) for _ in range(r.randrange(1, 40))).strip() for _ in range(300)]
    texts += ["a" * 72 + ", " + "b" * 200, "a" * 73 + ", " + "b" * 200, "a" * 178 + ", b" * 9, "a" * 177 + " — " + "b" * 50, "a" * 178 + " — " + "b" * 50, "a" * 180 + " b", "a" * 179 + " b"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", structure.capped(F.col("s")).alias("p")).collect()
    assert [(x.i, x.p) for x in got if x.p != (parts(texts[x.i]) if len(texts[x.i]) > 180 else [texts[x.i]])] == []


def test_sound_key_keeps_a_leading_vowel(spark):
    words = ["eau", "aab", "Étion", "bookkeeper", "excess", "", "1", "xx", "eck"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(expr.sound_key(F.col("w")).alias("k")).collect()
    assert [x.k for x in got] == ["e", "ab", "tn", "bkpr", "ekss".replace("ss", "s"), "", "", "ks" + "ks", "ek"]


def test_summary_sweep(spark):
    sections = spark.createDataFrame([(1, 0, 1, "Closure", 4), (1, 1, 2, "Best Practices", 59), (1, 2, 2, "Locks", 60), (1, 3, 2, "Requirements", 90), (2, 0, 1, "", 80)], "doc_id long, section int, level int, base string, words int")
    items = [(1, 1, "Best Practices", "a"), (1, 2, "Locks", "b"), (1, 2, "Closure — Locks", "c"), (1, 3, None, "d"), (1, 9, "gone", "e"), (1, None, "gone", "f"), (7, 0, "other", "g"), (None, 0, "other", "h"), (2, 0, "anything", "i"), (1, 2, "Closure — Locks", "c")]
    got = outline.summary_sweep(spark.createDataFrame(items, "doc_id long, section int, prompt string, id string"), sections).collect()
    assert sorted((r.id, r.action) for r in got) == [("a", "remove"), ("b", "rename"), ("c", "keep"), ("c", "keep"), ("d", "rename"), ("e", "unjudged"), ("f", "unjudged"), ("g", "unjudged"), ("h", "unjudged"), ("i", "keep")]
    assert {r.name for r in got if r.action == "rename"} == {"Closure — Locks", "Closure — Requirements"}


@pytest.mark.parametrize(
    "text, want",
    [
        ("***all*** of ___it___ and **b * c** __d_e__", "all of it and b * c d_e"),
        ("*one* _two_ * three * 2*3 _ four_", "one two * three * 2*3 _ four_"),
        ("~~gone~ by~~ 1\\* kept \\# a\\.b", "gone~ by 1* kept # a.b"),
        ("as said [1, 2–4] and [12 ] but [2024]", "as said and but [2024]"),
        ("stamps.13 He said \"data.\"8,19 and 312.62 of e.0083049", 'stamps. He said "data." and 312.62 of e.0083049'),
        ("see https://doi.org/jscdm.411 now", "see https://doi.org/jscdm.411 now"),
        ("Smith† and method‡§ end .", "Smith and method end."),
        ("<b>x</b>\n ![i](u) [l](u) `c`", "x l c"),
    ],
)
def test_inline_marks_go(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(expr.plain_inline(F.col("t")).alias("p")).first().p == want


def test_blocks_are_placed_in_sections_without_a_shuffle_of_their_words(spark):
    texts = ["plain line\n\nmore of it", "# One\n\n" + "word " * 720 + "\n\nnext\n\n## Two Parts\n\n- a\n- b\n\nend", "", "## References\n\nlast"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    b = structure.blocks(docs)
    s = structure.sections(b)
    of = s.select("doc_id", "section", "furniture", F.explode(F.sequence("block_from", F.col("block_to") - 1)).alias("block"))
    want = b.join(of, ["doc_id", "block"]).select("doc_id", "block", "section", "furniture", "text")
    got = entities.placed(b, s)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() == b.count() > 9
    words = structure.tokens(structure.chunks(got, "section", "furniture"), "section", "furniture")
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 2  # texts, once for each side and alike; neither blocks nor words
    assert words.where("core = 'word'").count() == 720


def test_blocks_pass_through_their_sections(spark):
    long = "\n".join(f"- {'w ' * 300}{k}" for k in range(7))
    b = structure.blocks(spark.createDataFrame([(1, "plain\n\n# One\nAlpha beta.\n\n## Two\n" + long + "\n# References\n- a"), (2, "# Only"), (3, "")], "doc_id long, text string"))
    got = structure.seated(b)
    want = entities.placed(b, structure.sections(b)).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 10


def test_words_are_chosen_before_they_are_rows(spark):
    text = "He met (Ann of) the Hill, and saw THE's 7 cats; x ab--cd  ef. (gh)  ij.  K9 of\n\nof\n\nthe Bar of Hope"
    c = structure.chunks(structure.blocks(spark.createDataFrame([(1, text)], "doc_id long, text string"))).withColumns({"section": F.lit(0), "furniture": F.lit(False)})
    every = papers.tagged(structure.tokens(c, "section", "furniture"))
    some = structure.tokens(c, like="[A-Z0-9]")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.select(some.columns).where(F.col("word").rlike("[A-Z0-9]")).collect()))
    lower = structure.lower_words(c)
    assert sorted(map(tuple, lower.collect())) == sorted(map(tuple, every.where(F.col("core").rlike("^[a-z]{2,}$")).select(lower.columns).collect()))
    named = papers.tagged(structure.tokens(c.where(F.col("text").rlike(entities.NAMED) | (F.col("n") <= entities.MOST_CONNECTORS)), "section", "furniture", like=entities.NAMING))
    short = every.where("acronym IS NOT NULL")
    got, want = entities.document_index(named, short, papers.tagged(structure.lower_words(c, "section", "furniture"))), entities.document_index(every)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, entities.mentions(named, short).collect())) == sorted(map(tuple, entities.mentions(every).collect())) and short.count() == 1


def test_near_misses_are_all_pairs_within_two_edits_and_look_up_few_pieces(spark):
    rng = random.Random(7)
    known = {"".join(rng.choice("ab c") for _ in range(rng.randint(6, 16))) for _ in range(150)}

    def edited(t):
        for _ in range(rng.randint(1, 3)):
            at, kind = rng.randrange(len(t)), rng.randrange(3)
            t = t[:at] + (rng.choice("abcx") if kind else "") + t[at + (kind < 2) :]
        return t

    made = {t: edited(t) for t in known}
    titles = spark.createDataFrame([(x,) for x in {*made.values(), *(edited(t) for t in known)}], "title string")
    topics_ = spark.createDataFrame([(x,) for x in known], "topic string")
    got = topics.near_misses(titles, topics_)
    pairs = titles.distinct().where(F.length("title") >= 8).crossJoin(topics_).withColumn("distance", F.levenshtein("title", "topic"))
    want = pairs.where(F.col("distance").between(1, 2)).join(topics_.select(F.col("topic").alias("title")), "title", "left_anti").select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    assert titles.select(F.size(topics._tried(F.col("title"), 2)).alias("n")).agg(F.max("n")).first()[0] <= 19


def test_dictated_turns_are_dealt_and_their_windows_carry_no_text(spark):
    turns = spark.createDataFrame([(k, k % 2, "see the bett ric scale at Kİ Betric now") for k in range(4)], "id long, scope long, text string")
    terms = spark.createDataFrame([(0, "Betric"), (1, "Scale")], "scope long, term string")
    out = dictation.reconciled(turns, terms)
    assert {(r.id % 2, tuple(c["from"] for c in r.corrections)) for r in out.collect()} == {(0, ("bett ric",)), (1, ("scale",))}
    assert "phrase" not in out._jdf.queryExecution().analyzed().toString()
