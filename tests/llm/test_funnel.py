"""Funnels against plain loops: ties, excluded rows, borders of blocks, one client with most rows, nulls and repeated rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from evalmill.llm import funnel
from evalmill.llm.funnel import FUNNELS, Funnel

SCHEMA = "client_id long, kind string, us long, t1 long, funnel string, block int"


def loops(rows, funnels, within, percent=90):
    """funnel, client: n1.., deepest, t2.., same_depth."""
    by = defaultdict(set)
    for c, k, t, *_ in rows:
        if None not in (c, k, t):
            by[c].add((t, k))
    steps, out = max(len(f.steps) for f in funnels), {}
    for f in funnels:
        for c, own in by.items():
            took = defaultdict(list)
            for first in (t for t, k in own if k == f.steps[0]):
                took[1].append(0)
                at = first
                for n, kind in enumerate(f.steps[1:], 2):
                    nexts = [t for t, k in own if k == kind and t > at]
                    if not nexts or min(nexts) > first + within or any(k == f.excluded and at < t <= min(nexts) for t, k in own):
                        break
                    took[n].append(min(nexts) - at)
                    at = min(nexts)
            if took:
                p = lambda n: sorted(took[n])[-(-percent * len(took[n]) // 100) - 1] if took[n] else None
                out[f.name, c] = [*(len(took[n]) for n in range(1, steps + 1)), max(n for n in took if took[n]), *(p(n) for n in range(2, steps + 1))]
    depths = [(f, x[steps]) for (f, _), x in out.items()]
    return sorted((f, c, *x, depths.count((f, x[steps]))) for (f, c), x in out.items())


@pytest.mark.parametrize(("seed", "blocks"), [(1, 1), (2, 4), (3, 2)])
def test_funnels_equal_loops(spark, seed, blocks):
    rng, within = random.Random(seed), 50
    kinds = ("view", "click", "purchase", "error", "signup", "other", None)
    # times on both sides of zero, many equal ones; client 7 has most rows, over many blocks
    rows = [(rng.choice((7, 7, 7, 1, 2, 3, None)), rng.choices(kinds, (6, 5, 4, 1, 1, 1, 1))[0], rng.choice((None, *range(-500, 1500))) if rng.random() < 0.9 else 100, 5, "f", 9) for _ in range(1500)]
    rows += rows[:200]
    short = [*FUNNELS, Funnel("D", ("view", "view")), Funnel("E", ("nothing", "view", "click"))]
    got = funnel.counted(spark.createDataFrame(rows, SCHEMA).repartition(3), short, within, blocks=blocks).collect()
    assert sorted(map(tuple, got)) == loops(rows, short, within)
    assert 4 in {r.deepest for r in got}


def test_ties_and_limits(spark):
    one = [Funnel("A", ("a", "b", "c"), "x")]
    cases = {
        1: ([("a", 0), ("b", 0), ("b", 10)], [1, 1, 0]),  # a candidate at the same time is not later
        2: ([("a", 0), ("b", 100)], [1, 1, 0]),  # just in time
        3: ([("a", 0), ("b", 101)], [1, 0, 0]),
        4: ([("a", 0), ("x", 0), ("b", 5)], [1, 1, 0]),  # excluded at the time of the step before
        5: ([("a", 0), ("x", 5), ("b", 5), ("b", 6)], [1, 0, 0]),  # at the time of the next step
        6: ([("a", 0), ("b", 5), ("x", 6), ("c", 7)], [1, 1, 0]),
        7: ([("a", 399), ("b", 400), ("c", 499)], [1, 1, 1]),  # over the border of blocks
        8: ([("a", -1), ("b", 0), ("c", 100)], [1, 1, 0]),
        9: ([("a", 0), ("a", 1), ("b", 2), ("c", 3)], [2, 2, 2]),  # attempts may share rows
    }
    rows = [(c, k, t, 0, "f", 0) for c, (xs, _) in cases.items() for k, t in xs]
    got = {r.client_id: [r.n1, r.n2, r.n3] for r in funnel.counted(spark.createDataFrame(rows, SCHEMA), one, 100).collect()}
    assert got == {c: want for c, (_, want) in cases.items()}
    assert funnel.counted(spark.createDataFrame([], SCHEMA), one, 100).count() == 0


def test_percentiles_of_many_times(spark):
    """Ranks of every size, over ranges of their own and within one."""
    rng = random.Random(4)
    rows = [("A", c, 2, rng.choice((rng.randrange(1 << 31), rng.randrange(1 << 12), 1 << 16, (1 << 16) - 1)), rng.randint(1, 3)) for c in range(30) for _ in range(c + 1)]
    rows = list({x[:4]: x for x in rows}.values())
    frame = spark.createDataFrame(rows, "funnel string, client_id long, step int, us long, c long")
    for percent in (1, 50, 90, 100):
        for r in funnel.ranked(frame, percent).collect():
            every = sorted(u for _, c, _, u, n in rows if c == r.client_id for _ in range(n))
            assert r.n == len(every) and r.us == every[-(-percent * len(every) // 100) - 1]


def test_one_shuffle_for_all_steps_and_times_without_a_zone(spark):
    rows = spark.createDataFrame([(1, "view", 5, 5, "f", 5)], SCHEMA)
    plan = funnel.attempts(rows, FUNNELS, 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Python" not in plan  # distinct rows, then client and block
    when = datetime(2024, 3, 10, 2, 30, 1, 250_007)  # an hour that some zones don't have
    t = spark.createDataFrame([(when,), (datetime(1969, 12, 31, 23, 59, 59),)], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert [r.us for r in t.select(funnel.micros(t, "t").alias("us")).collect()] == [(when - datetime(1970, 1, 1)) // timedelta(microseconds=1), -1_000_000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
