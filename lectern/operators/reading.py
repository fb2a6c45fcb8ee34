"""Reading time, pace and presence, from logs of reader events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.expr import half_up, near_ms

#: A gap counts as reading up to so many milliseconds; words and milliseconds that make a pace sample count.
GAP_MS, SAMPLE_WORDS, SAMPLE_MS = 1500, 40, 8000
#: Words a minute of an unknown voice; the control's range.
BASE_WPM, MIN_RATE, MAX_RATE = 185, 0.5, 2.0
#: Minutes that end a session.
AWAY_MIN = 15


def active_time(events: DataFrame) -> DataFrame:
    """``reader, events, active_ms``: gaps between a reader's events in milliseconds, each moment to the nearest, each gap up to the cap."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (near_ms(F.col("ts")) - near_ms(F.lag("ts").over(order))).alias("gap")
    rows = events.select(F.col("user_id").alias("reader"), gap)
    return rows.groupBy("reader").agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(F.least("gap", F.lit(GAP_MS))), F.lit(0)).alias("active_ms"))


def pace_table(samples: DataFrame) -> DataFrame:
    return samples.groupBy("voice", "tenths").agg(F.sum("words").alias("words"), F.sum("ms").alias("ms"))


def pace_runs(samples: DataFrame) -> DataFrame:
    """``voice, run, tenths, samples, words``: consecutive samples of a voice at one rate."""
    order = Window.partitionBy("voice").orderBy("ts", "event_id")
    rows = samples.withColumn("new", (~F.col("tenths").eqNullSafe(F.lag("tenths").over(order))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("voice", "run", "tenths").agg(F.count(F.lit(1)).alias("samples"), F.sum("words").alias("words"))


def pace_fit(samples: DataFrame) -> DataFrame:
    """``voice, points, slope, intercept``: a line through a voice's rates; through the origin where none rises."""
    points = pace_table(samples).where((F.col("words") >= SAMPLE_WORDS) & (F.col("ms") >= SAMPLE_MS))
    points = points.select("voice", (F.col("tenths") / 10).alias("rate"), (F.col("words") / (F.col("ms") / 60000)).alias("wpm"))
    fit = points.groupBy("voice").agg(F.count(F.lit(1)).alias("points"), F.regr_slope("wpm", "rate").alias("s"), F.regr_intercept("wpm", "rate").alias("i"), F.avg("wpm").alias("w"), F.avg("rate").alias("r"))
    rises = (F.col("points") > 1) & (F.col("s") > 0)
    return fit.select("voice", "points", F.round(F.when(rises, F.col("s")).otherwise(F.col("w") / F.col("r")), 6).alias("slope"), F.round(F.when(rises, F.col("i")).otherwise(0.0), 6).alias("intercept"))


def pace_solve(samples: DataFrame, target: int = 200) -> DataFrame:
    """``voice, rate, expected_wpm, clamped``: the rate that should give the target."""
    fit = pace_fit(samples)
    wanted = half_up((F.lit(target) - F.col("intercept")) / F.col("slope") * 10) / 10
    rate = F.least(F.lit(MAX_RATE), F.greatest(F.lit(MIN_RATE), wanted))
    rows = fit.withColumn("rate", rate)
    expected = F.greatest(F.lit(1), half_up((F.col("intercept") + F.col("slope") * F.col("rate")) / 5) * 5)
    return rows.withColumn("expected_wpm", expected).select("voice", "rate", "expected_wpm", (F.abs(F.col("expected_wpm") - target) > 5).alias("clamped"))


def sessions(events: DataFrame, minutes: int = AWAY_MIN) -> DataFrame:
    """``reader, started, ended, events``: sessions that a gap closes; the same on a stream, with a watermark."""
    w = F.session_window("ts", f"{minutes} minutes")
    return events.groupBy(w.alias("w"), F.col("user_id").alias("reader")).agg(F.count(F.lit(1)).alias("events")).select("reader", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def value_windows(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """``started, event_type, events, total``: sums by tumbling window; the same on a stream."""
    w = F.window("ts", size)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("started"), "event_type", "events", "total")


def wpm_windows(samples: DataFrame) -> DataFrame:
    """``kind, started, words, wpm``: words a minute by the hour, and by the hour at each quarter of one."""

    def by(kind: str, w: Column) -> DataFrame:
        rows = samples.groupBy(w.alias("w")).agg(F.sum("words").alias("words"), F.sum("ms").alias("ms")).where("ms > 0")
        return rows.select(F.lit(kind).alias("kind"), F.col("w.start").alias("started"), "words", half_up(F.col("words") / (F.col("ms") / 60000)).alias("wpm"))

    return by("tumbling", F.window("ts", "1 hour")).unionByName(by("sliding", F.window("ts", "1 hour", "15 minutes")))


def latency_ema(events: DataFrame, keep: float = 0.7, stretch: str = "HOUR") -> DataFrame:
    """``reader, ema``: values smoothed in order of time, the first as it is; null values don't count.

    Smoothing a stretch of the log is an affine map of what came before, ``keep ** n * x + b``. Each stretch gives its
    map by a sum of weighted values, and a reader's maps, one an hour of the log, are applied in order: no row holds
    a reader's values.
    """
    rows = events.where("value IS NOT NULL").select(F.col("user_id").alias("reader"), F.date_trunc(stretch, "ts").alias("part"), "ts", "event_id", "value")
    late = Window.partitionBy("reader", "part").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    weighted = rows.withColumn("w", F.col("value") * (1 - keep) * F.pow(F.lit(keep), F.row_number().over(late) - 1))
    maps = weighted.groupBy("reader", "part").agg(F.pow(F.lit(keep), F.count(F.lit(1))).alias("a"), F.sum("w").alias("b"), F.min_by("value", F.struct("ts", "event_id")).alias("first"))
    by = maps.groupBy("reader").agg(F.sort_array(F.collect_list(F.struct("part", "a", "b", "first"))).alias("maps"))
    fold = F.aggregate("maps", F.col("maps")[0]["first"], lambda s, m: s * m["a"] + m["b"])
    return by.select("reader", F.round(fold, 6).alias("ema"))
