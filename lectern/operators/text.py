"""Text into lines, sentences, tokens, clauses and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import expr

#: Words of a stretch after which the next block starts another part; of a section that is worth a stop.
STRETCH_WORDS, STOP_WORDS = 700, 60

#: What ends a sentence and what starts the next.
SENTENCE = r"([.!?][.!?\"'’”)\]]*)\s+([\"'“‘(\[]?[A-Z0-9])"

#: Words whose full stop ends no sentence.
ABBREVIATIONS = (
    "mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "st.", "mt.", "vs.", "etc.", "e.g.", "i.e.", "cf.", "al.", "fig.", "no.", "vol.", "inc.", "ltd.", "co.", "corp.", "dept.",
    "est.", "approx.", "ca.", "jan.", "feb.", "mar.", "apr.", "jun.", "jul.", "aug.", "sep.", "sept.", "oct.", "nov.", "dec.", "u.s.", "u.k.", "a.m.", "p.m.", "ph.d.",
)

#: A single letter or an abbreviation at the end of a piece: the next piece belongs to it.
OPEN_END = r"(?i)(^|\s)([a-z]\.|" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + ")$"


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``: every line, numbered from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, block, line``: lines with a word, numbered from 0 inside the row's own array."""
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(kept).alias("block", "line"))


def tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, block, at, word, starts``: words of each block; ``starts`` marks the first of a sentence-like start."""
    words = F.filter(F.split("line", " "), lambda w: w != "")
    return blocks(docs).select("doc_id", "block", F.posexplode(words).alias("at", "word"))


def clauses(docs: DataFrame) -> DataFrame:
    """``doc_id, block, n_clauses``: a clause ends at a comma, colon, semicolon or dash, and at the block's end."""
    words = F.filter(F.split("line", " "), lambda w: w != "")
    ends = F.filter(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: w.rlike(r"[,;:][\"'’”)\]]?$|[—–]$"))
    return blocks(docs).select("doc_id", "block", (F.size(ends) + 1).alias("n_clauses"))


def block_words(docs: DataFrame) -> DataFrame:
    """``doc_id, block, words``."""
    return blocks(docs).select("doc_id", "block", F.size(F.filter(F.split("line", " "), lambda w: w != "")).alias("words"))


def sections(docs: DataFrame) -> DataFrame:
    """``doc_id, part, first_block, n_blocks, words, stops``: a stretch that reaches 700 words ends with its block.

    The running sum starts again at each cut, so it is folded over the document's own block sizes.
    """
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    sizes = F.transform(kept, lambda x: F.size(F.split(x, " ")))
    rows = docs.select("doc_id", sizes.alias("sizes")).where(F.size("sizes") > 0)
    start = F.struct(F.lit(0).alias("words"), F.lit(1).alias("part"), F.array().cast("array<int>").alias("parts"))
    fold = F.aggregate(
        "sizes",
        start,
        lambda s, n: F.struct(
            F.when(s["words"] + n >= STRETCH_WORDS, 0).otherwise(s["words"] + n).alias("words"),
            F.when(s["words"] + n >= STRETCH_WORDS, s["part"] + 1).otherwise(s["part"]).alias("part"),
            F.concat(s["parts"], F.array(s["part"])).alias("parts"),
        ),
        lambda s: s["parts"],
    )
    placed = rows.select("doc_id", F.posexplode(F.arrays_zip(fold.alias("part"), F.col("sizes").alias("n"))).alias("block", "b")).select("doc_id", "block", F.col("b.part").alias("part"), F.col("b.n").alias("n"))
    out = placed.groupBy("doc_id", "part").agg(F.min("block").alias("first_block"), F.count(F.lit(1)).alias("n_blocks"), F.sum("n").alias("words"))
    return out.withColumn("stops", F.col("words") >= STOP_WORDS)


def reading_times(docs: DataFrame, wpm: int = 185) -> DataFrame:
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    seconds = n / F.lit(wpm) * 60
    return docs.select("doc_id", n.alias("words"), F.round(seconds, 3).alias("seconds"), expr.duration(seconds).alias("label"))


def repeated_lines(docs: DataFrame, share: float = 0.35) -> DataFrame:
    """First and last lines of documents, digits masked, that recur in a source: twice, and in a share of its documents."""
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.select("doc_id", "source", kept.alias("k")).where(F.size("k") > 0)
    edges = rows.select("doc_id", "source", F.explode(F.array_distinct(F.transform(F.array(F.get("k", F.lit(0)), F.element_at("k", -1)), lambda x: F.regexp_replace(x, "[0-9]+", "#")))).alias("line"))
    counts = edges.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    return counts.join(totals, counts["source"].eqNullSafe(totals["source"])).where(F.col("n") >= F.greatest(F.lit(2.0), F.col("docs") * share)).select(counts["source"], "line", "n")


def frequent_lines(docs: DataFrame, least: int = 2) -> DataFrame:
    """Lines that documents share: ``line, docs, times``."""
    rows = blocks(docs)
    return rows.groupBy("line").agg(F.count_distinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("times")).where(F.col("docs") >= least)
