"""Times of reading against their SQL, at parts of a millisecond."""

import datetime

import duckdb

from lectern.plans import registry

DAY = datetime.datetime(2024, 1, 1)


def told(spark, folder, name, rows):
    """A query's rows and its SQL's over ``events`` of these rows."""
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{folder}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(folder))
    return sorted(map(tuple, df.collect()), key=repr), sorted(c.execute(f"SELECT {', '.join(chr(34) + x + chr(34) for x in df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall(), key=repr)


def short_gaps(day, step):
    return [(i, day + datetime.timedelta(microseconds=i * i * step), 1 + i % 3, "click", 1.0, '{"k": 1}') for i in range(300)]


def test_active_time_of_gaps_shorter_than_the_cap(spark, tmp_path):
    rows = short_gaps(DAY, 1733) + [(900 + k, datetime.datetime(1969, 12, 31, 23, 59, 59, 999_000 + k), 9, "view", 1.0, None) for k in (0, 500, 600)]
    got, want = told(spark, tmp_path, "active_time", rows)
    assert got == want and got[-1] == (9, 3, 1500 + 1)


def test_pace_of_short_gaps(spark, tmp_path):
    got, want = told(spark, tmp_path, "effective_wpm", short_gaps(DAY, 43))
    assert got == want and len(got) == 3
