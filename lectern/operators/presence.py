"""Presence checks of readers and results of spot checks, from whole logs; ``streaming.presence`` has their streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds without a sign of life before a check is raised, and seconds more before it counts as missed.
CHECK_S, ANSWER_S = 90, 3.5


def checks(events: DataFrame, until=None) -> DataFrame:
    """``reader, kind, at``: when a reader's presence check is raised, missed, and cleared by the next sign of life.

    ``until`` ends the log: nothing that would happen later is told; by default it is the last event of any reader. A
    sign of life at the moment of a deadline comes first. Times are in milliseconds. Events without reader or time
    are no signs of life.
    """
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select(F.col("user_id").alias("reader"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    end = rows.agg(F.max("ms")).scalar() if until is None else until
    after = F.lead("ms").over(Window.partitionBy("reader").orderBy("ms"))
    rows = rows.withColumn("after", after).withColumn("end", end)
    told = lambda kind, at, when: F.when(when & (at <= F.col("end")), F.struct(F.lit(kind).alias("kind"), at.alias("ms")))
    raised, missed = F.col("ms") + CHECK_S * 1000, F.col("ms") + int((CHECK_S + ANSWER_S) * 1000)
    alone = lambda at: F.col("after").isNull() | (F.col("after") > at)
    found = F.array(told("raised", raised, alone(raised)), told("missed", missed, alone(missed)), told("cleared", F.col("after"), F.col("after") > raised))
    out = rows.select("reader", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    return out.select("reader", "x.kind", F.timestamp_millis("x.ms").cast("timestamp_ntz").alias("at"))


def latest_results(results: DataFrame) -> DataFrame:
    """``reader, doc_id, begin, to, blanks, recalled``: of each window's results the latest; of those of one moment that with the greatest ``event_id``."""
    best = F.max_by(F.struct("begin", "blanks", "recalled"), F.struct("ms", "event_id")).alias("r")
    return results.groupBy("reader", "doc_id", "to").agg(best).select("reader", "doc_id", "r.begin", "to", "r.blanks", "r.recalled")


def boundary_tokens(boundaries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``event_id, reader, doc_id, chunk, token, advances``: the word that each boundary of speech has reached.

    A boundary names a character of a sentence; its word is the last that starts there or before, the sentence's first
    where none does, and -1 where there is no such sentence. ``advances`` tells whether the reader has not been there:
    engines repeat early places. A sentence's words start at places of its own row, so the as-of lookup is an equality
    join with one row a sentence, which splits where a sentence is hot, and words are never exploded.
    """
    words = F.filter(F.split("text", " "), lambda w: w != "")
    starts = F.aggregate(
        words,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, w: F.struct((s["at"] + F.length(w) + 1).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")),
        lambda s: s["starts"],
    )
    places = chunks.select("doc_id", "chunk", "start", starts.alias("starts"))  # of 180 characters at most
    found = boundaries.join(places, ["doc_id", "chunk"], "left")
    reached = F.greatest(F.size(F.filter("starts", lambda x: x <= F.col("char_index"))) - 1, F.lit(0))
    found = found.withColumn("token", F.when(F.col("starts").isNull(), F.lit(-1)).otherwise(F.col("start") + reached).cast("long"))
    before = Window.partitionBy("reader", "doc_id", "chunk").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return found.select("event_id", "reader", "doc_id", "chunk", "token", (F.col("token") > F.coalesce(F.max("token").over(before), F.lit(-1))).alias("advances"))
