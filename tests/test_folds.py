"""Folds over long logs, and papers, against plain loops."""

import datetime
import random

import pytest

from lectern.operators import papers, reading, review

DAY = datetime.datetime(2024, 1, 1)


def test_smoothing_by_stretches_equals_a_loop(spark):
    r = random.Random(1)
    rows = [(i, DAY + datetime.timedelta(minutes=r.randrange(0, 600)), i % 5, r.choice([None, 1.5, r.random() * 100])) for i in range(700)]
    rows += [(1000 + i, DAY + datetime.timedelta(seconds=i // 9), 9, float(i % 97)) for i in range(20_000)] + [(1, DAY, 77, None)]
    want = {}
    for i, t, u, v in sorted(rows, key=lambda x: (x[1], x[0])):
        if v is not None:
            want[u] = v if u not in want else want[u] * 0.7 + v * 0.3
    got = {x.reader: x.ema for x in reading.latency_ema(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double")).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def test_review_of_a_long_log(spark):
    n = 300_000
    log = spark.range(n).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "7L AS reader", "1 AS item", "cast(pmod(xxhash64(id), 4) AS int) AS quality").repartition(3)
    ease, reps, lapses = 2.5, 0, 0
    for q in (x.quality for x in sorted(log.collect(), key=lambda x: x.event_id)):
        ease = min(2.8, max(1.3, ease + (-0.8, -0.15, 0.0, 0.15)[q]))
        reps, lapses = (0, lapses + 1) if q == 0 else (reps + 1, lapses)
    got = review.review_state(log).first()
    assert (got.answers, got.reps, got.lapses, got.ease) == (n, reps, lapses, pytest.approx(ease, abs=1e-6))


def test_review_of_nulls_and_nothing(spark):
    schema = "event_id long, ts timestamp_ntz, reader long, item int, quality int"
    rows = [(1, DAY, None, 1, 3), (2, DAY, None, 1, 0), (3, None, 1, None, 2), (4, DAY, 1, 1, None)]
    got = {(x.reader, x.item): (x.answers, x.lapses) for x in review.review_state(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(None, 1): (2, 1), (1, None): (1, 0)} and review.review_state(spark.createDataFrame([], schema)).count() == 0


def pool_rows(pools):
    return [(d, f"{d}:{kind}:{k}", kind, m, k + 1) for d, kinds in pools.items() for kind, meanings in kinds.items() for k, m in enumerate(meanings)]


def drawn(spark, pools, count, seed="seed"):
    rows = spark.createDataFrame(pool_rows(pools), "doc_id long, id string, kind string, meaning string, place int")
    return [(x.id, x.kind, x.doc_id) for x in papers.paper(rows, seed, count).orderBy("place").collect()]


def fnv(text):
    h = 2166136261
    for c in text:
        h = ((h ^ ord(c)) * 16777619) % 2**32
    return h


def round_robin(pools, count, seed="seed"):
    """The rule read plainly, over all pools at once."""
    mix, picks, asked = {"acronym": 0.35, "cloze": 0.45, "grid": 0.2}, [], set()
    more = True
    while more and len(picks) < count:
        more = False
        for d in sorted(pools, key=lambda d: (fnv(f"{seed}:docs{d}"), d)):
            if len(picks) >= count:
                break
            offers = []
            for k, kind in enumerate(mix):
                left = [(i, m) for i, m in enumerate(pools[d].get(kind, ())) if m not in asked]
                if left:
                    offers.append((mix[kind] * (len(picks) + 1) - sum(p[1] == kind for p in picks), -k, kind, left[0]))
            if offers:
                _, _, kind, (i, m) = max(offers, key=lambda x: (x[0], x[1]))
                picks.append((f"{d}:{kind}:{i}", kind, d))
                asked.add(m)
                more = True
    return picks


def many(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


@pytest.mark.parametrize("count", [5, 12, 40])
def test_paper_equals_the_round_robin(spark, count):
    r = random.Random(count)
    pools = {d: {kind: r.sample(many(kind, r.choice((2, 9, 30))), 2) for kind in ("acronym", "cloze", "grid") if r.random() < 0.6} for d in range(60)}
    pools |= {d: {"acronym": ["acronym0"]} for d in range(100, 160)}
    assert drawn(spark, pools, count) == round_robin(pools, count)


def test_paper_cases(spark):
    rich = {1: {"acronym": many("A", 12), "cloze": many("c", 12), "grid": many("g", 12)}, 2: {"acronym": many("B", 2), "cloze": many("d", 2)}, 3: {"acronym": many("C", 6), "cloze": many("e", 6), "grid": many("h", 2)}}
    got = drawn(spark, rich, 12)
    assert {d for _, _, d in got} == {1, 2, 3} and len(got) == 12
    assert len(drawn(spark, {1: {"acronym": ["CRF", "EDC"], "cloze": ["sponsor"]}, 2: {"acronym": ["CRF", "EDC"], "cloze": ["sponsor"]}}, 10)) == 3
    kinds = [k for _, k, _ in drawn(spark, {1: {"acronym": many("A", 20), "cloze": many("c", 20)}, 2: {"acronym": many("B", 20), "cloze": many("d", 20)}}, 20)]
    assert len(kinds) == 20 and kinds.count("cloze") > kinds.count("acronym") and "grid" not in kinds
    kinds = [k for _, k, _ in drawn(spark, {1: {"acronym": many("A", 20), "cloze": many("c", 20), "grid": many("g", 20)}}, 20)]
    assert (kinds.count("cloze"), kinds.count("acronym"), kinds.count("grid")) == (9, 7, 4)
    assert drawn(spark, rich, 12) == got and drawn(spark, {}, 5) == []
