"""The outline of a document: which chapter a section stands in, its full name, search, and how ambiguous names are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The deepest level of a heading; 0 is the document itself.
DEEPEST = 3

#: Fixed value: a section of fewer words never owed a summary.
SUMMARY_WORDS = 60


def _plain(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))


def chapters(sections: DataFrame) -> DataFrame:
    """``sections`` with ``chapter``, the nearest earlier title of a smaller level, null where there is none.

    One window over the document's sections has the last title of each level; the row's own level says which it takes.
    """
    before = Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.last(F.when(F.col("level") < k, F.col("base")), ignorenulls=True).over(before).alias(f"_above{k}") for k in range(1, DEEPEST + 1)]
    rows = sections.select("*", *above)
    return rows.withColumn("chapter", F.coalesce(*(F.when(F.col("level") == k, F.col(f"_above{k}")) for k in range(1, DEEPEST + 1)))).drop(*(f"_above{k}" for k in range(1, DEEPEST + 1)))


def qualified(sections: DataFrame) -> DataFrame:
    """``chapters`` with ``name``: chapter and title; the title alone without a chapter or where the chapter says the same."""
    own, chapter = F.trim("base"), F.trim(F.coalesce("chapter", F.lit("")))
    name = F.when((chapter == "") | (own == ""), F.when(own != "", own).otherwise(chapter)).when(_plain(F.col("chapter")) == _plain(F.col("base")), own).otherwise(F.concat(chapter, F.lit(" — "), own))
    return chapters(sections).withColumn("name", name)


def search(sections: DataFrame, query: str) -> DataFrame:
    """``chapters`` of the sections whose own title or chapter holds the query; all of them for an empty query."""
    needle = " ".join(query.lower().split())
    rows = chapters(sections)
    if not needle:
        return rows
    return rows.where(F.contains(_plain(F.col("base")), F.lit(needle)) | F.coalesce(F.contains(_plain(F.col("chapter")), F.lit(needle)), F.lit(False)))


def ambiguous(sections: DataFrame) -> DataFrame:
    """``doc_id, stops, shared, titles, names``: sections that stop the reader, those that share a title, distinct titles, distinct full names."""
    rows = qualified(sections).where("intercept")
    by = rows.groupBy("doc_id", "base").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))  # names of one title only: told apart by their chapters
    full = rows.groupBy("doc_id").agg(F.count_distinct("name").alias("names"))
    out = by.groupBy("doc_id").agg(F.sum("n").alias("stops"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("shared"), F.count(F.lit(1)).alias("titles"))
    return out.join(full, "doc_id")


def summary_sweep(items: DataFrame, sections: DataFrame) -> DataFrame:
    """``items(doc_id, section, prompt, ...)`` with ``action`` and ``name``, the prompt that a summary should have.

    A summary of a section too short to be asked about is to ``remove``, one whose section has another full name to
    ``rename``, any other is to ``keep``. What names no section that is there (or none) is ``unjudged``, never removed.
    Repeated items are judged alike; an empty table gives none.
    """
    known = qualified(sections).select("doc_id", "section", F.col("words").alias("_words"), "name")
    action = F.when(F.col("_words").isNull(), "unjudged").when(F.col("_words") < SUMMARY_WORDS, "remove").when((F.col("name") != "") & ~F.col("name").eqNullSafe(F.col("prompt")), "rename").otherwise("keep")
    return items.join(known, ["doc_id", "section"], "left").withColumn("action", action).drop("_words")
