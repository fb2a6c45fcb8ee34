"""Presence checks and latest check results: the batch against plain loops, the streams against the batch."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import presence
from lectern.streaming import presence as stream
from lectern.streaming import readers

DAY = datetime.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long"


def at(seconds):
    return DAY + datetime.timedelta(seconds=seconds)


def walked(signs, until):
    """One reader's checks, by a clock that ticks every half second."""
    out, last, told, signs = [], None, 0, sorted(signs)
    for tick in range(0, int(until * 2) + 1):
        now = tick / 2
        while signs and signs[0] <= now:
            last = signs.pop(0)
            if told:
                out.append(("cleared", at(last)))
            told = 0
        if last is not None and told == 0 and now >= last + 90:
            told = 1
            out.append(("raised", at(now)))
        if last is not None and told == 1 and now >= last + 93.5:
            told = 2
            out.append(("missed", at(now)))
    return out


def rows_of(df):
    return sorted((r.reader, r.kind, r["at"]) for r in df.collect())


def test_checks_equal_a_ticking_clock(spark):
    r = random.Random(4)
    signs = {k: [r.choice((r.randrange(0, 2400) / 2, 100, 190, 193.5, 280)) for _ in range(r.randrange(1, 25))] for k in range(12)}
    rows = [(i, at(x), k) for k, v in signs.items() for i, x in enumerate(v)] + [(99, None, 1), (98, at(5), None)]
    got = presence.checks(spark.createDataFrame(rows, EVENTS))
    until = max(x for v in signs.values() for x in v)
    assert rows_of(got) == sorted((k, *x) for k, v in signs.items() for x in walked(v, until))
    assert presence.checks(spark.createDataFrame([], EVENTS)).count() == 0


def streamed(spark, folder, rows, schema, files, change):
    """``rows`` dealt over files as they are, one file a micro-batch."""
    for k in range(files):
        spark.createDataFrame(rows[k * len(rows) // files : (k + 1) * len(rows) // files], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return change(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("ts", "10 minutes"))


def test_check_stream_equals_the_batch_with_rows_out_of_order(spark, tmp_path):
    r = random.Random(5)
    rows = sorted(((i, at(r.randrange(0, 12_000) / 2), r.randrange(4)) for i in range(160)), key=lambda x: x[1] + datetime.timedelta(seconds=r.randrange(0, 500)))
    got = readers.settled(streamed(spark, tmp_path, rows, EVENTS, 5, stream.checks), "append", stream.STORE)
    wm = max(x[1] for x in rows) - datetime.timedelta(minutes=10)
    want = presence.checks(spark.createDataFrame([x for x in rows if x[1] <= wm], EVENTS), F.unix_millis(F.lit(wm).cast("timestamp")))
    assert got.select("_batch").distinct().count() > 2
    assert rows_of(got.select("reader", "kind", F.timestamp_millis("ms").cast("timestamp_ntz").alias("at"))) == rows_of(want)


RESULTS = "ts timestamp, event_id long, reader long, doc_id long, begin int, `to` int, blanks int, recalled int"


def test_result_stream_equals_the_batch_and_drops_late_rows(spark, tmp_path):
    r = random.Random(6)
    rows = [(at(60 * i + r.randrange(0, 400)), i, r.randrange(2), r.randrange(2), 0, 250 * r.randrange(1, 3), 3, i % 4) for i in range(150)]
    rows += [(at(60 * 149), 200, 0, 0, 0, 250, 3, 1), (at(60 * 149), 201, 0, 0, 0, 250, 3, 2)]
    late = (at(0), 999, 5, 5, 0, 250, 3, 3)  # its own key: were it not dropped, it would be seen
    rows += [(at(60 * 150 + 3 * 86_400), 300, 1, 1, 0, 250, 3, 2), late]
    got = readers.settled(streamed(spark, tmp_path, rows, RESULTS, 6, lambda s: stream.latest(s.withColumn("ms", F.unix_millis("ts")))), "update", stream.STORE)
    want = presence.latest_results(spark.createDataFrame([x for x in rows if x != late], RESULTS).withColumn("ms", F.unix_millis("ts")))
    assert sorted(map(tuple, presence.latest_results(got).collect())) == sorted(map(tuple, want.collect()))
    assert got.where("reader = 5").count() <= 1


@pytest.mark.parametrize("ms", [0, 1])
def test_a_sign_of_life_at_the_deadline_comes_first(spark, ms):
    rows = [(1, at(0), 1), (2, at(90) + datetime.timedelta(milliseconds=ms), 1), (3, at(90.5), 2)]
    kinds = [k for r, k, _ in rows_of(presence.checks(spark.createDataFrame(rows, EVENTS))) if r == 1]
    assert kinds == (["cleared", "raised"] if ms else [])


def test_results_of_the_stream_are_ordered_by_the_nearest_millisecond(spark, tmp_path):
    """As in the SQL: 0.6 ms and 1.4 ms are one moment, so that the greater ``event_id`` holds; no Python runs for each window."""
    parts = [(7, 600), (6, 1400), (21, 1600), (22, 2400), (33, 400), (30, 600)]
    rows = [(e, DAY + datetime.timedelta(microseconds=us), e // 10, "click", 3.0, '{"k": 4}') for e, us in parts]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = stream.check_results(spark, str(tmp_path))
    assert {r.reader: r.recalled for r in df.collect()} == {0: 3, 2: 2, 3: 2}
    results = spark.readStream.schema(RESULTS).parquet(str(tmp_path)).withWatermark("ts", "10 minutes")
    assert "Pandas" not in stream.latest(results.withColumn("ms", F.unix_millis("ts")))._jdf.queryExecution().logical().toString()
