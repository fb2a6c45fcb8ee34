"""The given tables, seen as a library of documents, reader answers, papers and samples of pace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with byte order marks and carriage returns normalised; the title is the first line with a word."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿", ""), "\r\n?", "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), "lang", "source")
    first = F.trim(F.regexp_extract("text", r"([^\n]*[^\s][^\n]*)", 1))
    return rows.withColumn("title", F.when(first == "", "Untitled document").otherwise(F.substring(first, 1, 80)))


def as_answers(events: DataFrame) -> DataFrame:
    """Reader events, a table or a stream, as answers: an error fails, a view is hard, a click good, a purchase easy.

    Other events, as signing up, answer nothing and are left out.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    quality = F.expr("CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END")
    rows = events.select("event_id", "ts", F.col("user_id").alias("reader"), (k % 7).alias("item"), quality.alias("quality"))
    return rows.where("quality IS NOT NULL AND item IS NOT NULL")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_answers(table(spark, sf_dir, "events"))


def pace_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader events as spans of speech: a voice at a rate spoke words for some milliseconds."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("voice"),
        (F.lit(10) + k % 5).alias("tenths"),
        F.floor("value").cast("long").alias("words"),
        (F.floor("value") * (F.lit(360) - F.lit(20) * (k % 5))).cast("long").alias("ms"),
    )


def paper_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's day of answers as a paper: an item is right if it was clicked or bought."""
    rows = answers(spark, sf_dir).withColumn("day", F.to_date("ts"))
    paper = F.concat_ws("-", "reader", F.date_format("day", "yyyyMMdd"))
    kind = F.element_at(F.array(F.lit("cloze"), F.lit("grid"), F.lit("acronym")), (F.col("item") % 3 + 1).cast("int"))
    return rows.select("event_id", "reader", "ts", "day", paper.alias("paper"), "item", kind.alias("kind"), (F.col("quality") >= 2).alias("correct"))


#: What becomes of a web page's markup, in this order: hidden parts go, headings and items get marks, blocks end lines.
MARKUP = (
    ("(?is)<script[^>]*>.*?</script>", ""),
    ("(?is)<style[^>]*>.*?</style>", ""),
    ("(?is)<title[^>]*>.*?</title>", ""),
    ("(?s)<!--.*?-->", ""),
    ("(?i)<h1[^>]*>", "\n\n# "),
    ("(?i)<(h2[^>]*>|p><b>)", "\n\n## "),
    ("(?i)<h3[^>]*>", "\n\n### "),
    ("(?i)<li[^>]*>", "\n- "),
    ("(?i)</?(p|ul|ol|div|article|nav|br|h[1-6]|head|body|footer|section)[^>]*>", "\n\n"),
    ("<[^>]*>", ""),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
)


def marked(html: Column) -> Column:
    """A page's markup as marks at the starts of lines; a bold start of a paragraph is a second-level heading."""
    text = F.coalesce(html, F.lit(""))
    for pattern, by in MARKUP:
        text = F.regexp_replace(text, pattern, by)
    return text


def page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, source``: web pages as marked-up text."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), marked(F.col("html")).alias("text"), F.regexp_extract("url", "://([^/]+)", 1).alias("source"))


def reader_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reader, doc_id, caret, checked``: reader events as reading of pages; the page is the event's number, two words a unit of value."""
    rows = _reading(spark, sf_dir).groupBy("reader", "doc_id").agg(F.max("caret").alias("caret"))
    return rows.withColumn("checked", (F.floor(F.col("caret") / 250) * 250).cast("int"))


def as_check_results(events: DataFrame) -> DataFrame:
    """``ts, event_id, reader, doc_id, begin, to, blanks, recalled``: clicks, of a table or a stream, as results of spot checks of 250 words."""
    k, to = F.get_json_object("props", "$.k").cast("long"), (F.floor(F.floor(F.col("value") * 2).cast("int") / 250) * 250 + 250).cast("int")
    rows = events.where("event_type = 'click'").select("ts", "event_id", F.col("user_id").alias("reader"), k.alias("doc_id"), (to - 250).alias("begin"), to.alias("to"), F.lit(3).alias("blanks"), (F.col("event_id") % 4).cast("int").alias("recalled"))
    return rows.where("doc_id IS NOT NULL")


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, ts, reader, doc_id, chunk, char_index``: reader events as boundaries of speech in the first sentences of a page."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("reader"), k.alias("doc_id"), (F.col("event_id") % 4).cast("int").alias("chunk"), F.floor("value").cast("int").alias("char_index"))
    return rows.where("doc_id IS NOT NULL")


def spot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reader, doc_id, from, to, blanks, recalled``: clicks as answered spot checks; the latest of a window holds."""
    rows = _reading(spark, sf_dir).where("event_type = 'click'").withColumn("to", (F.floor(F.col("caret") / 250) * 250 + 250).cast("int"))
    last = rows.groupBy("reader", "doc_id", "to").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("e"))
    return last.select("reader", "doc_id", (F.col("to") - 250).alias("from"), "to", F.lit(3).alias("blanks"), (F.col("e") % 4).cast("int").alias("recalled"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``reader, doc_id, section``: purchases as summaries of one of a page's first four sections."""
    return _reading(spark, sf_dir).where("event_type = 'purchase'").select("reader", "doc_id", (F.col("event_id") % 4).cast("int").alias("section")).distinct()


def _reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("reader"), "event_type", k.alias("doc_id"), F.floor(F.col("value") * 2).cast("int").alias("caret")).where("doc_id IS NOT NULL")
