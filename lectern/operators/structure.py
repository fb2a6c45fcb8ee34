"""Marked-up text as blocks, sections, sentences and numbered words.

A document's rows are numbered by windows over the document. Positions count words from the start of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.text import OPEN_END, SENTENCE, STOP_WORDS, STRETCH_WORDS

#: Characters of a sentence that is heard as one; a cut at a stop must leave more than this share of them.
LONGEST, CUT_SHARE = 180, 0.4

#: What a line is by how it starts, first match first; blank lines and prose are what is left.
KINDS = (("h1", r"^#\s+\S"), ("h2", r"^##\s+\S"), ("h3", r"^#{3,6}\s+\S"), ("li", r"^\s*[-*+]\s+\S"), ("li", r"^\s*\d+[.)]\s+\S"), ("quote", r"^\s*>\s*\S"))

#: Headings that end the document proper, the contents, and lists of authors.
TRAILING = r"(?i)^(references?|bibliography|works cited|revision history|competing interests?|conflicts? of interest|acknowledge?ments?|funding|author contributions?|open access|copyright|about the authors?|disclaimer)\b"
CONTENTS, CITED, RUN_ON = r"(?i)^(table of )?contents$", r"(?i)\bet al\b|\bdoi\b|https?:", r"[a-z],[A-Z]|\band[A-Z]"

#: Sections from the start in which the contents, and in which lists of authors, are looked for.
CONTENTS_WITHIN, AUTHORS_WITHIN = 12, 6

#: What is taken off the start of a marked line.
MARKS = r"^(#{1,6}\s+|\s*[-*+]\s+|\s*\d+[.)]\s+|\s*>\s*)"


def _by_doc(*order) -> Window:
    return Window.partitionBy("doc_id").orderBy(*order)


def _words(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda w: w != "")


def kinds(docs: DataFrame) -> DataFrame:
    """``doc_id, at, kind, ordinal, body``: each line with a word by its mark, and what stands after the mark."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    kind = F.when(F.trim(F.regexp_replace("line", r"\s+", " ")) == "", "blank")
    for name, pattern in KINDS:
        kind = kind.when(F.col("line").rlike(pattern), name)
    kind = kind.otherwise("p")
    body = F.trim(F.regexp_replace(F.when(kind == "p", F.col("line")).otherwise(F.regexp_replace("line", MARKS, "")), r"\s+", " "))
    number = F.when(kind == "li", F.regexp_extract("line", r"^\s*(\d+)[.)]", 1))
    return lines.select("doc_id", "at", kind.alias("kind"), F.when(number != "", number.cast("int")).alias("ordinal"), body.alias("body"))


def blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, block, kind, text, words, start``: consecutive prose lines are one block, any other marked line is one."""
    rows = kinds(docs)
    joins = (F.col("kind") == "p") & (F.coalesce(F.lag("kind").over(_by_doc("at")), F.lit("")) == "p")
    rows = rows.withColumn("island", F.sum(F.when(joins, 0).otherwise(1)).over(_by_doc("at"))).where("kind <> 'blank'")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "body"))), lambda x: x["body"]), " ")
    out = rows.groupBy("doc_id", "island").agg(F.first("kind").alias("kind"), text.alias("text"))
    out = out.withColumn("words", F.size(_words(F.col("text")))).withColumn("block", F.row_number().over(_by_doc("island")) - 1)
    before = F.sum("words").over(_by_doc("block").rowsBetween(Window.unboundedPreceding, -1))
    return out.select("doc_id", "block", "kind", "text", "words", F.coalesce(before, F.lit(0)).alias("start"))


def placed(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``seed``, the number of the heading's stretch, and ``title`` and ``level`` of the nearest heading at or before it."""
    heading = F.col("kind").isin("h1", "h2", "h3")
    first = F.first(heading).over(_by_doc("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    seed = F.sum(heading.cast("int")).over(_by_doc("block")) - first.cast("int")
    near = F.last(F.when(heading, F.struct(F.col("text").alias("title"), F.substring("kind", 2, 1).cast("int").alias("level"))), ignorenulls=True).over(_by_doc("block"))
    rows = blocks.withColumn("seed", seed).withColumn("near", near)
    return rows.select(*blocks.columns, "seed", F.coalesce("near.title", F.lit("Opening")).alias("title"), F.coalesce("near.level", F.lit(0)).alias("level"))


def sections(blocks: DataFrame, *held: str) -> DataFrame:
    """``doc_id, section, title, base, part, level, block_from, block_to, token_from, token_to, words, furniture, intercept``; with ``held``, the section's blocks with these columns.

    A heading's stretch that reaches 700 words goes on as another part from the next block on; the fold over a stretch's
    blocks keeps the places of its cuts only. Blocks and tokens are half-open ranges.
    """
    by = placed(blocks).groupBy("doc_id", "seed", "title", "level").agg(F.sort_array(F.collect_list(F.struct("block", "words", "start", *held))).alias("b"))
    place = lambda x: F.struct(x["block"].alias("block"), x["start"].alias("start"))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<block:int,start:bigint>>").alias("cuts"))
    over = lambda s: s["n"] >= STRETCH_WORDS
    fold = F.aggregate("b", start, lambda s, x: F.struct((F.when(over(s), 0).otherwise(s["n"]) + x["words"]).cast("int").alias("n"), F.when(over(s), F.concat(s["cuts"], F.array(place(x)))).otherwise(s["cuts"]).alias("cuts")), lambda s: s["cuts"])
    last = F.element_at("b", -1)
    # A part's words stand between its first block's start and the next part's.
    rows = by.withColumn("cuts", F.concat(F.array(place(F.col("b")[0])), fold)).withColumn("end", F.struct((last["block"] + 1).alias("block"), (last["start"] + last["words"]).alias("start")))
    rows = rows.select("doc_id", "seed", "title", "level", "cuts", "end", *(["b"] if held else []), F.posexplode("cuts").alias("k", "cut"))
    rows = rows.withColumn("next", F.coalesce(F.get("cuts", F.col("k") + 1), F.col("end"))).withColumn("block_from", F.col("cut.block")).withColumn("block_to", F.col("next.block"))
    rows = rows.withColumn("words", (F.col("next.start") - F.col("cut.start")).cast("int"))
    named = F.when(F.col("k") == 0, F.col("title")).otherwise(F.concat("title", F.lit(" (part "), (F.col("k") + 1).cast("string"), F.lit(")")))
    rows = rows.select(
        "doc_id", (F.row_number().over(_by_doc("block_from")) - 1).alias("section"), named.alias("title"), F.col("title").alias("base"), F.when(F.size("cuts") > 1, F.col("k") + 1).alias("part"),
        F.when(F.col("k") == 0, F.col("level")).otherwise(2).alias("level"), "block_from", "block_to", F.col("cut.start").cast("int").alias("token_from"), "words",
        *([F.slice("b", (F.col("block_from") - F.col("b")[0]["block"] + 1).cast("int"), (F.col("block_to") - F.col("block_from")).cast("int")).alias("held")] if held else []),
    )
    rows = rows.withColumn("token_to", (F.col("token_from") + F.col("words")).cast("int"))
    whole = Window.partitionBy("doc_id")
    contents = F.max(F.when((F.col("section") < CONTENTS_WITHIN) & F.col("title").rlike(CONTENTS), F.col("section"))).over(whole)
    listed = (F.col("section") < AUTHORS_WITHIN) & (F.col("title").rlike(CITED) | F.col("title").rlike(RUN_ON))
    rows = rows.withColumn("furniture", (F.col("section") <= F.coalesce(contents, F.lit(-1))) | F.col("title").rlike(TRAILING) | listed)
    intercept = F.col("level").isin(1, 2) & (F.col("words") >= STOP_WORDS) & ~F.col("furniture")
    return rows.select("doc_id", "section", "title", "base", "part", "level", "block_from", "block_to", "token_from", "token_to", "words", "furniture", intercept.alias("intercept"), *(["held"] if held else []))


def seated(blocks: DataFrame) -> DataFrame:
    """``blocks`` with their ``section`` and ``furniture``: they pass through the making of sections, so that they are made once and nothing is joined."""
    rows = sections(blocks, "kind", "text").select("doc_id", "section", "furniture", F.explode("held").alias("b"))
    return rows.select("doc_id", "b.block", "b.kind", "b.text", "b.words", "b.start", "section", "furniture")


def owing(sections: DataFrame) -> DataFrame:
    """``sections`` with ``owes``: long enough itself, no furniture, and the next section that is no furniture stops the reader."""
    after = _by_doc("section").rowsBetween(1, Window.unboundedFollowing)
    entered = F.first(F.when(~F.col("furniture"), F.col("intercept")), ignorenulls=True).over(after)
    return sections.withColumn("owes", ~F.col("furniture") & (F.col("words") >= STOP_WORDS) & F.coalesce(entered, F.lit(False)))


def content(sections: DataFrame) -> DataFrame:
    """``doc_id, content_words, first_token``: words outside furniture, and where the first section with such words starts."""
    own = ~F.col("furniture")
    return sections.groupBy("doc_id").agg(F.sum(F.when(own, F.col("words")).otherwise(0)).alias("content_words"), F.coalesce(F.min(F.when(own & (F.col("words") > 0), F.col("token_from"))), F.lit(0)).alias("first_token"))


def folded(sections: DataFrame) -> DataFrame:
    """``doc_id, section, base, parts, words, token_to``: the parts of one heading as one row."""
    goes_on = (F.coalesce(F.col("part"), F.lit(1)) > 1) & (F.lag("base").over(_by_doc("section")) == F.col("base"))
    rows = sections.withColumn("run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(_by_doc("section")))
    return rows.groupBy("doc_id", "run").agg(F.min("section").alias("section"), F.first("base").alias("base"), F.count(F.lit(1)).alias("parts"), F.sum("words").alias("words"), F.max("token_to").alias("token_to")).drop("run")


def _part(longest: int) -> str:
    """The next part of a text, as a pattern: all that is left, else up to the last stop inside the limit, else to the last space, else to the limit."""
    least = int(longest * CUT_SHARE) + 1
    # A stop is a semicolon or comma before a space, or the space before a dash; all of it stands inside the limit.
    stop = rf".{{{longest - 2}}}[;,](?= )|.{{{least},{longest - 3}}}(?:[;,](?= )| (?=[—–] ))"
    return rf"(?s) *(.{{1,{longest}}}\z|{stop}|.{{1,{longest - 1}}}(?= )|.{{{longest}}})"


def capped(sentence: Column, longest: int = LONGEST) -> Column:
    """The parts of a sentence: cut at the last stop inside the limit, else at the last space, else at the limit. One pass of a pattern, however long the text."""
    parts = F.filter(F.transform(F.regexp_extract_all(sentence, F.lit(_part(longest)), 1), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.length(sentence) <= longest, F.array(sentence)).otherwise(parts)


def sentences(blocks: DataFrame, line: str = "text") -> DataFrame:
    """``blocks`` with ``at`` and ``sentence`` for each of a line's sentences; a piece after an abbreviation belongs to the one before it.

    Pieces and starts are columns of their own, so that the lambdas read them instead of building them.
    """
    rows = blocks.withColumn("_pieces", F.split(F.regexp_replace(line, SENTENCE, "$1\u001f$2"), "\u001f"))
    pieces = F.col("_pieces")
    rows = rows.withColumn("_starts", F.filter(F.transform(pieces, lambda p, i: F.when((i == 0) | ~F.get(pieces, i - 1).rlike(OPEN_END), i)), lambda i: i.isNotNull()))
    starts = F.col("_starts")
    found = F.transform(starts, lambda i, k: F.array_join(F.slice(pieces, i + 1, F.coalesce(F.get(starts, k + 1), F.size(pieces)) - i), " "))
    return rows.select(*blocks.columns, F.posexplode(found).alias("at", "sentence"))


def chunks(blocks: DataFrame, *also: str) -> DataFrame:
    """``doc_id, chunk, block, kind, text, n, start, stop``: what is heard as one sentence, with its range of words; ``also``: further columns of the block."""
    rows = sentences(blocks).select("doc_id", "block", "kind", *also, "at", F.posexplode(capped(F.col("sentence"))).alias("part", "text"))
    rows = rows.withColumn("n", F.size(_words(F.col("text"))))
    order = _by_doc("block", "at", "part")
    rows = rows.withColumn("chunk", F.row_number().over(order) - 1).withColumn("stop", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("doc_id", "chunk", "block", "kind", "text", "n", (F.col("stop") - F.col("n")).alias("start"), "stop", *also)


def tokens(chunks: DataFrame, *also: str, like: str | None = None) -> DataFrame:
    """``doc_id, i, chunk, block, kind, at, word, core``: every word by its place in the document and in its sentence, and without its shell; ``also``: further columns of the sentence; ``like``: words that hold this pattern only.

    The core is made inside the sentence's row, so that conditions on it read it instead of matching its pattern again.
    """
    from lectern.operators.vocab import CORE

    core = lambda w: F.when(w.rlike("^[A-Za-z0-9]+$"), w).otherwise(F.regexp_extract(w, CORE, 1))
    found = F.transform(_words(F.col("text")), lambda w, at: F.struct(at.alias("at"), w.alias("word")))
    if like:
        found = F.filter(found, lambda x: x["word"].rlike(like))
    found = F.transform(found, lambda x: F.struct(x["at"].alias("at"), x["word"].alias("word"), core(x["word"]).alias("core")))
    rows = chunks.select("doc_id", "chunk", "block", "kind", "start", *also, F.explode(found).alias("w"))
    return rows.select("doc_id", (F.col("start") + F.col("w.at")).alias("i"), "chunk", "block", "kind", "w.at", "w.word", "w.core", *also)


def lower_words(chunks: DataFrame, *also: str) -> DataFrame:
    """``doc_id, kind, core`` of ``tokens`` whose core is two letters or more, all in lower case: one pass of a pattern over each sentence."""
    found = F.regexp_extract_all("text", F.lit(r"(?<![^ ])[^A-Za-z0-9 ]*([a-z]{2,})[^A-Za-z0-9 ]*(?![^ ])"), 1)
    return chunks.select("doc_id", "kind", *also, F.explode(found).alias("core"))


def lead_letters(word: Column) -> Column:
    """How many characters of a word stand before the cut of its leading letters; all of a word without a letter."""
    head = F.length(F.regexp_extract(word, "^([^A-Za-zÀ-ɏ]*)", 1))
    letters = F.length(F.regexp_extract(word, "^[^A-Za-zÀ-ɏ]*([A-Za-zÀ-ɏ][A-Za-zÀ-ɏ'’-]*)", 1))
    lead = F.when(letters <= 3, 1).otherwise(F.greatest(F.lit(1), F.floor(letters * 0.45 + 0.5)))
    return F.when(letters == 0, F.length(word)).otherwise(head + lead).cast("int")
