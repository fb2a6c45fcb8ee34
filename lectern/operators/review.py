"""Spaced-repetition state, papers and misses, from logs of answers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.expr import half_up

#: Ease: at the start, least, most, and the change for each quality of answer.
EASE, MIN_EASE, MAX_EASE, CHANGES = 2.5, 1.3, 2.8, (-0.8, -0.15, 0.0, 0.15)
#: Days of the longest interval; lapses that make an item fully weak; items listed as due; papers listed.
MAX_DAYS, WEAK_LAPSES, DUE_LIMIT, PAPERS = 180, 3, 40, 30


def review_state(answers: DataFrame, horizon_days: int | None = None) -> DataFrame:
    """``reader, item, ease, days, reps, lapses, answers, last, due``: each item's answers folded in order of time.

    An item's answers pass a task one by one in sorted order, which Spark spills; only the state of one item is held,
    however long its log. Answers of one moment are taken by ``event_id``; nulls are a reader and an item like others.
    """
    cap = MAX_DAYS if horizon_days is None else min(MAX_DAYS, max(1, horizon_days))
    keys = ["reader", "item"]
    kinds = {c: answers.schema[c].dataType.simpleString() for c in (*keys, "ts")}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ease, days, reps, lapses, n, last = None, EASE, 0, 0, 0, 0, None
        schema = None
        for batch in batches:
            schema = schema or [batch.schema.field(c).type for c in (*keys, "ts")]
            done = []
            for reader, item, ts, q in zip(*(batch.column(c).to_pylist() for c in (*keys, "ts", "quality"))):
                if now != (reader, item):
                    if now:
                        done.append((*now, ease, days, reps, lapses, n, last))
                    now, ease, days, reps, lapses, n = (reader, item), EASE, 0, 0, 0, 0
                ease = min(MAX_EASE, max(MIN_EASE, ease + CHANGES[q]))
                n, last = n + 1, ts
                if q == 0:
                    days, reps, lapses = 0, 0, lapses + 1
                else:
                    reps += 1
                    days = min(cap, (3 if q == 3 else 1) if reps == 1 else (3 if q == 1 else 6) if reps == 2 else max(1, math.floor(days * ease + 0.5)))
            if done:
                yield made(done, schema)
        if now:
            yield made([(*now, ease, days, reps, lapses, n, last)], schema)

    def made(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        types = [*kinds[:2], pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), kinds[2]]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*keys, "ease", "days", "reps", "lapses", "answers", "last"])

    log = answers.where("quality IS NOT NULL").select(*keys, "ts", "event_id", "quality").repartition(*keys).sortWithinPartitions(*keys, "ts", "event_id")
    out = log.mapInArrow(fold, f"reader {kinds['reader']}, item {kinds['item']}, ease double, days int, reps int, lapses int, answers long, last {kinds['ts']}")
    due = F.when(F.col("days") == 0, F.col("last") + F.expr("INTERVAL 10 MINUTES")).otherwise(F.col("last") + F.make_dt_interval(F.col("days")))
    return out.select(*keys, F.round("ease", 6).alias("ease"), "days", "reps", "lapses", "answers", "last", due.alias("due"))


def difficulty(state: DataFrame) -> DataFrame:
    lapses = F.least(F.lit(1.0), F.col("lapses") / WEAK_LAPSES)
    ease = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(EASE) - F.col("ease")) / (EASE - MIN_EASE)))
    return state.select("reader", "item", F.round(F.greatest(lapses, ease), 6).alias("weight"))


def weak_terms(state: DataFrame) -> DataFrame:
    return difficulty(state).groupBy("item").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("readers")).where("weight > 0")


def due_list(state: DataFrame, now: str, limit: int = DUE_LIMIT) -> DataFrame:
    """The items that have been due longest."""
    return state.where(F.col("due") <= F.lit(now).cast("timestamp")).select("reader", "item", "due").orderBy("due", "reader", "item").limit(limit)


def due_counts(state: DataFrame, now: str) -> DataFrame:
    return state.groupBy("reader").agg(F.count_if(F.col("due") <= F.lit(now).cast("timestamp")).alias("due"), F.count(F.lit(1)).alias("items"))


def interval_label(state: DataFrame) -> DataFrame:
    months = half_up(F.col("days") / 30)
    label = (
        F.when(F.col("days") <= 0, "10 minutes").when(F.col("days") == 1, "1 day").when(F.col("days") < 30, F.concat(F.col("days").cast("string"), F.lit(" days")))
        .when(months == 1, "1 month").otherwise(F.concat(months.cast("string"), F.lit(" months")))
    )
    return state.select("reader", "item", label.alias("label"))


def deadlines(dates: DataFrame, today: str) -> DataFrame:
    """``o_orderkey``-like key, days left, the horizon that reviews keep to, and a label, for rows of ``key, day``."""
    left = F.datediff("day", F.lit(today).cast("date"))
    horizon = F.when(left > 0, F.greatest(F.lit(1), F.floor(left * 0.5)))
    label = F.when(left == 0, "today").when(left == 1, "tomorrow").when(left > 1, F.concat(F.lit("in "), left.cast("string"), F.lit(" days"))).when(left == -1, "yesterday").otherwise(F.concat(F.abs(left).cast("string"), F.lit(" days ago")))
    return dates.select("key", left.alias("days_left"), horizon.cast("long").alias("horizon"), label.alias("label"))


def paper_score(answers: DataFrame) -> DataFrame:
    """``paper, kind, correct, total``: each paper as a whole (null kind) and by kind."""
    return answers.groupingSets([["paper"], ["paper", "kind"]], "paper", "kind").agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total")).select("paper", "kind", "correct", "total")


def papers(answers: DataFrame) -> DataFrame:
    return answers.groupBy("reader", "paper", "day").agg(half_up(F.count_if("correct") * 100 / F.count(F.lit(1))).alias("percent"))


def paper_trend(answers: DataFrame) -> DataFrame:
    """Each reader's number of papers, latest percentage, change, best, and mean of the last three."""
    by, rest = Window.partitionBy("reader").orderBy(F.col("day").desc()), Window.partitionBy("reader")
    rows = papers(answers).withColumn("rank", F.row_number().over(by)).withColumn("before", F.lead("percent").over(by)).withColumn("best", F.max("percent").over(rest)).withColumn("papers", F.count(F.lit(1)).over(rest))
    recent = rows.withColumn("mean3", F.round(F.avg(F.when(F.col("rank") <= 3, F.col("percent"))).over(rest), 4))
    return recent.where("rank = 1").select("reader", "papers", F.col("percent").alias("latest"), (F.col("percent") - F.col("before")).alias("change"), "best", "mean3")


def repeat_misses(answers: DataFrame) -> DataFrame:
    """Items a reader missed on two papers or more."""
    missed = answers.where("NOT correct")
    return missed.groupBy("reader", "item").agg(F.count_distinct("paper").alias("papers"), F.max("ts").alias("last")).where("papers >= 2")


def paper_misses(answers: DataFrame) -> DataFrame:
    return answers.where("NOT correct").groupBy("paper", "item", "kind").agg(F.count(F.lit(1)).alias("misses"))


def recent_papers(answers: DataFrame, limit: int = PAPERS) -> DataFrame:
    return papers(answers).orderBy(F.col("day").desc(), "paper").limit(limit).select("paper", "day", "percent")
