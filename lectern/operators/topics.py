"""Coverage of required topics by a library's titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.expr import title_key


def required_topics(benchmark: DataFrame) -> DataFrame:
    """``topic, title, groups``: first lines of required texts, one topic for each normalised title."""
    first = F.trim(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0)))
    rows = benchmark.select("item_id", first.alias("title"), title_key(first).alias("topic")).where("topic <> ''")
    return rows.groupBy("topic").agg(F.min_by("title", "item_id").alias("title"), F.count_distinct(F.col("item_id") % 6).alias("groups"))


#: Characters of a title that can be all but another; edits that it may be away.
LEAST_TITLE, MOST_EDITS = 8, 2


def _pieces(key, most: int):
    """``at, piece`` of a text in ``most + 1`` pieces of about one length: of two texts so many edits apart, one holds a piece of the other unchanged."""
    n, parts = F.length(key), most + 1
    start = lambda k: F.floor(n * k / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: F.struct(k.alias("k"), start(k).alias("at"), F.substring(key, start(k) + 1, start(k + 1) - start(k)).alias("piece")))


def near_misses(titles: DataFrame, topics: DataFrame, resembled: DataFrame | None = None, least: int = LEAST_TITLE, most: int = MOST_EDITS) -> DataFrame:
    """``title, topic, distance``: titles one or two edits from a topic that are no topic, nor listed as resembling one.

    A topic is kept under its length and each of three pieces; a title looks up its own substrings of the pieces' lengths
    for each length within two edits. Of a topic's pieces, the first that is whole has ``k`` edits before it and the
    others after it, so piece ``k`` is looked for at most ``k`` places off and as near to the place counted from the end.
    So candidates meet by equality of hashed keys, and only they are measured. Keys under eight characters are too short
    to tell.
    """
    known = topics.select("topic").distinct()
    own = titles.select(F.col("title")).distinct().where(F.length("title") >= least).join(known.select(F.col("topic").alias("title")), "title", "left_anti")
    if resembled is not None:
        own = own.join(resembled.select("title").distinct(), "title", "left_anti")
    kept = known.where(F.length("topic") >= least - most).select("topic", F.length("topic").alias("n"), F.explode(_pieces(F.col("topic"), most)).alias("p"))
    kept = kept.select("topic", F.xxhash64("n", "p.k", "p.piece").alias("key"))
    tried = own.select("title", F.explode(_tried(F.col("title"), most)).alias("p")).select("title", F.xxhash64("p.n", "p.k", "p.piece").alias("key"))
    met = tried.join(kept, "key").select("title", "topic").distinct()
    return met.withColumn("distance", F.levenshtein("title", "topic", most)).where(F.col("distance").between(1, most))


def _tried(title, most: int):
    """``n, k, piece``: the substrings of a title that may be piece ``k`` of a text of length ``n``, by how many edits may stand before and after it."""
    length, parts = F.length(title), most + 1
    out = []
    for far in range(-most, most + 1):  # the title's length less the other's
        n = length - far
        for k in range(parts):
            start, stop = F.floor(n * k / parts).cast("int"), F.floor(n * (k + 1) / parts).cast("int")
            for off in range(max(-k, far - (most - k)), min(k, far + (most - k)) + 1):
                at = start + off
                out.append(F.when((at >= 0) & (at + stop - start <= length), F.struct(n.alias("n"), F.lit(k).alias("k"), F.substring(title, at + 1, stop - start).alias("piece"))))
    return F.filter(F.array(*out), lambda p: p.isNotNull())


def resembling(titles: DataFrame, listed: DataFrame) -> DataFrame:
    """``title, topics``: titles that are listed as look-alikes of topics, which they don't count for."""
    by = listed.groupBy("title").agg(F.sort_array(F.collect_set("topic")).alias("topics"))
    return titles.select("title").distinct().join(by, "title")
