"""Acronyms, names and phrases in documents."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import structure, text

#: The acronyms that occur, their expansions and categories.
ACRONYMS = (("THE", "the hourly estimate", "time"), ("OF", "office form", "paper"), ("DE", "data entry", "paper"), ("TO", "time out", "time"), ("ERHE", "early relief", "care"), ("AND", "annual note digest", "paper"))

#: Quotations kept of each document.
QUOTATIONS = 3

CORE = r"^[^A-Za-z0-9]*(.*?)[^A-Za-z0-9]*$"


def dictionary(spark) -> DataFrame:
    return spark.createDataFrame(list(ACRONYMS), "key string, expansion string, category string")


def acronym_tags(docs: DataFrame) -> DataFrame:
    """``doc_id, key, expansion, n``: acronyms by document, plurals included; the dictionary is a fixed small table."""
    words = text.tokens(docs).where(F.col("word").rlike("[A-Z]")).select("doc_id", F.regexp_extract("word", CORE, 1).alias("core"))
    known = dictionary(docs.sparkSession)
    forms = known.select("key", "expansion", F.explode(F.array(F.col("key"), F.concat("key", F.lit("s")), F.concat("key", F.lit("'s")))).alias("core"))
    return words.join(F.broadcast(forms), "core").groupBy("doc_id", "key", "expansion").agg(F.count(F.lit(1)).alias("n"))


def acronym_expansions(docs: DataFrame) -> DataFrame:
    """``doc_id, block, spoken``: blocks that hold an acronym, with the acronyms written out inside their shells, plurals kept."""
    forms = F.create_map(*(F.lit(x) for k, e, _ in ACRONYMS for end in ("", "s", "'s", "’s") for x in (k + end, e + end)))
    core = lambda w: F.regexp_extract(w, CORE, 1)
    words = F.transform(F.split("line", " "), lambda w: F.coalesce(F.replace(w, core(w), F.try_element_at(forms, core(w))), w))
    return text.blocks(docs).where(F.col("line").rlike("[A-Z]")).select("doc_id", "block", "line", F.array_join(words, " ").alias("spoken")).where("spoken <> line").drop("line")


def phrase_hits(docs: DataFrame, phrase: str) -> DataFrame:
    """``doc_id, block, at, line, hits``: sentences that hold the words of a phrase in a row, whatever stands around them.

    The last word may take its other forms. Occurrences do not overlap, and none crosses the end of a sentence. Only
    blocks that hold the phrase at all are cut into sentences.
    """
    words = [w for w in phrase.lower().split() if w]
    k = len(words)
    near = r"(?i)" + r"\s+".join(rf"[^A-Za-z0-9\s]*{re.escape(w)}[^\s]*" for w in words[:-1]) + (r"\s" if k > 1 else "")
    rows = text.blocks(docs).where(F.col("line").rlike(near) if k > 1 else F.lit(True))
    rows = structure.sentences(rows, "line").withColumn("cores", F.transform(F.filter(F.split("sentence", " "), lambda w: w != ""), lambda w: F.lower(F.regexp_extract(w, CORE, 1))))
    # Each place's next words side by side, so that the lambda reads its own element alone.
    shifted = F.arrays_zip(*(F.slice("cores", F.lit(j + 1), F.lit(1 << 30)).alias(f"w{j}") for j in range(k)))
    last = final_forms(F.lit(words[-1]))
    same = F.transform(shifted, lambda c, i: F.when(reduce(and_, [*(c[f"w{j}"] == w for j, w in enumerate(words[:-1])), F.array_contains(last, c[f"w{k - 1}"])]), i))
    places = F.filter(same, lambda i: i.isNotNull())
    # The fold keeps the last occurrence's place.
    hits = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last")), lambda s, i: F.when(i >= s["last"] + k, F.struct((s["n"] + 1).alias("n"), i.alias("last"))).otherwise(s), lambda s: s["n"])
    return rows.select("doc_id", "block", "at", F.col("sentence").alias("line"), hits.alias("hits")).where("hits > 0")


def phrase_sites(docs: DataFrame, phrase: str) -> DataFrame:
    """The first quotations of each document, sentences, with the document's number of occurrences."""
    hits = phrase_hits(docs, phrase)
    by_doc, order = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("block", "at")
    ranked = hits.withColumn("total", F.sum("hits").over(by_doc)).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= QUOTATIONS).select("doc_id", "rank", "block", "line", "hits", "total")


def phrase_docs(docs: DataFrame, phrase: str) -> DataFrame:
    return phrase_hits(docs, phrase).groupBy("doc_id").agg(F.sum("hits").alias("total"))


def catalog_search(docs: DataFrame, query: str) -> DataFrame:
    """Documents whose title, source and language hold every term of a query."""
    hay = F.lower(F.concat_ws(" ", "title", "source", "lang"))
    terms = F.array(*(F.lit(t) for t in query.lower().split()))
    return docs.where(F.forall(terms, lambda t: F.contains(hay, t))).select("doc_id", "title", "source")


def final_forms(word: Column) -> Column:
    """The forms that a phrase's last word may take: itself, two plurals, and its singulars where it is a plural."""
    n = F.length(word)
    plural = (n > 3) & F.endswith(word, F.lit("s")) & ~F.endswith(word, F.lit("ss"))
    forms = F.array(word, F.concat(word, F.lit("s")), F.concat(word, F.lit("es")), F.when(plural, F.substring(word, F.lit(1), n - 1)), F.when(plural & F.endswith(word, F.lit("es")), F.substring(word, F.lit(1), n - 2)))
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull()))


def short_name(label: Column) -> Column:
    """A label without its maker in front and what stands after its last dash; the label itself where nothing is left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(label, r"(?i)^(microsoft|google|apple)\s+", ""), r"\s*-\s*[^-]+$", ""))
    return F.when(bare == "", label).otherwise(bare)
