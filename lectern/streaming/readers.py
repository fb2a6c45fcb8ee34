"""Reader events as a stream: the batch operators under a watermark, and state kept for each item."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators import library, reading, review
from lectern.sources import tables

WATERMARK = "1 hour"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def settled(stream: DataFrame, mode: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over all that is there, under the settings ``conf``, and reads back what it wrote; the folder is shared where the cluster names one."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    folder = library.shared_folder(spark, "lectern-stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(f"{folder}/out")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    return settled(reading.sessions(source(spark, sf_dir).withWatermark("ts", WATERMARK)), "append").select("reader", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "events")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows in update mode: the last row of each window holds."""
    out = settled(reading.value_windows(source(spark, sf_dir).withWatermark("ts", WATERMARK)), "update")
    return out.groupBy("started", "event_type").agg(F.max_by(F.struct("events", "total"), "_batch").alias("v")).select(F.col("started").cast("timestamp_ntz").alias("started"), "event_type", "v.*")


def item_state(stream: DataFrame) -> DataFrame:
    """``reader, item, ease, reps, lapses``: one state row an item, changed by each of its answers in order of time."""
    state, output = "ease double, reps int, lapses int", "reader long, item int, ease double, reps int, lapses int"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        ease, reps, lapses = held.get if held.exists else (review.EASE, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for q in rows["quality"]:
            ease = min(review.MAX_EASE, max(review.MIN_EASE, ease + review.CHANGES[int(q)]))
            reps, lapses = (0, lapses + 1) if q == 0 else (reps + 1, lapses)
        held.update((ease, reps, lapses))
        yield pd.DataFrame({"reader": [key[0]], "item": [key[1]], "ease": [round(ease, 6)], "reps": [reps], "lapses": [lapses]})

    return stream.groupBy("reader", "item").applyInPandasWithState(fold, output, state, "update", GroupStateTimeout.NoTimeout)


def item_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every item after all answers: the last row that the stream wrote for it."""
    out = settled(item_state(tables.as_answers(source(spark, sf_dir))), "update")
    return out.groupBy("reader", "item").agg(F.max_by(F.struct("ease", "reps", "lapses"), "_batch").alias("s")).select("reader", "item", "s.*")
