"""The log as a stream against the batch rules: any order of arrival, doubled events, queries that are stopped and started again, state that is cleared."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from evalmill.operators import events as E
from evalmill.sources.versions import Table
from evalmill.streaming import eventlog as L

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def log(spark, seed, jobs=12, n=260):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choices((E.STARTED, E.OUTPUT, E.TERMINAL), (3, 3, 1))[0]
        rows.append((i, f"run-{i % 2}", f"j{rng.randrange(jobs)}", rng.choice(("parse", "test")), kind, T0 + timedelta(seconds=i, microseconds=rng.randrange(10**6)), rng.choice((None, "t1", "t2")), None))
    return rows, spark.createDataFrame(rows, L.LOG)


def delivered(spark, path, rows, seed, files=5, reach=40):
    """Files in which events come out of order, within some reach, and a third of them twice."""
    rng = random.Random(seed)
    sent = [(r[0] + rng.uniform(0, reach), r) for r in rows] + [(r[0] + rng.uniform(0, reach), r) for r in rows if rng.random() < 0.34]
    sent.sort(key=lambda x: x[0])
    step = -(-len(sent) // files)
    for k in range(files):
        spark.createDataFrame([r for _, r in sent[k * step : (k + 1) * step]], L.LOG).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(L.LOG).option("maxFilesPerTrigger", 1).parquet(path)


def ended(query):
    assert query.awaitTermination(240) and query.exception() is None
    return query


def plain(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_streams_equal_batches(spark, tmp_path):
    rows, batch = log(spark, 1)
    at = lambda n: str(tmp_path / n)
    events = lambda: L.once(spark.readStream.schema(L.LOG).option("maxFilesPerTrigger", 1).parquet(at("log")), "2 minutes")
    delivered(spark, at("log"), rows, 1)
    ended(L.append(events(), at("once"), at("c1")))
    assert plain(spark.read.parquet(at("once")), "seq", "job_id", "event") == plain(batch, "seq", "job_id", "event")
    query = ended(L.append(L.timing_changes(events()), at("changes"), at("c2")))
    changes = spark.read.parquet(at("changes"))
    want = plain(E.stage_timing(batch), "job_id", "stage", "latency_us")
    assert plain(L.timing_of(changes), "job_id", "stage", "latency_us") == want and len(query.recentProgress) >= 5
    assert changes.groupBy("job_id", "stage").agg(F.sum("outputs").alias("n")).where("n <> 1").count() == 0  # what is added up is the last value
    rates = Table(spark, at("rates"), ("stage",))
    ended(L.keep(L.rates(L.read_changes(spark, at("changes"), 1)), rates, at("c3")))
    by_batch = E.throughput(E.stage_timing(batch), E.job_tasks(batch)).where("task_id IS NULL")
    assert plain(L.with_rate(rates.read()), "stage", "outputs", "total_us", "samples_per_second") == plain(by_batch, "stage", "outputs", "total_us", "samples_per_second")
    counts = Table(spark, at("counts"), ("run_id", "stage"))
    ended(L.keep(L.counts(events()), counts, at("c4")))
    for run in ("run-0", "run-1"):
        assert plain(counts.read().where(F.col("run_id") == run), "stage", "started", "completed", "terminals") == plain(E.status(E.of_run(batch, run)), "stage", "started", "completed", "terminals")
    tasks = Table(spark, at("tasks"), ("job_id",))
    ended(L.keep(L.job_tasks(events()), tasks, at("c5")))
    assert plain(tasks.read(), "job_id", "task_id") == plain(E.job_tasks(batch), "job_id", "task_id")


def test_a_query_is_stopped_and_started_again(spark, tmp_path):
    """On its checkpoint, with some files before and some after: state goes on where it was."""
    rows, batch = log(spark, 3)
    at = lambda n: str(tmp_path / n)
    events = lambda: L.once(spark.readStream.schema(L.LOG).option("maxFilesPerTrigger", 1).parquet(at("log")), "5 minutes")
    for k, part in enumerate((rows[:100], rows[60:180], rows[180:])):
        delivered(spark, at("log"), part, k, files=2)
        ended(L.append(L.timing_changes(events()), at("changes"), at("c")))
    assert plain(L.timing_of(spark.read.parquet(at("changes"))), "job_id", "stage", "latency_us") == plain(E.stage_timing(batch), "job_id", "stage", "latency_us")


def test_state_is_cleared_by_timers(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    early = [(i, "r", f"j{i % 50}", "parse", (E.STARTED, E.OUTPUT)[i // 50], T0 + timedelta(seconds=i), None, None) for i in range(100)]
    late = [(1000 + i, "r", f"k{i}", "parse", E.STARTED, T0 + timedelta(hours=5 + i), None, None) for i in range(4)]
    events = lambda: L.once(spark.readStream.schema(L.LOG).option("maxFilesPerTrigger", 1).parquet(at("log")), "10 seconds")
    held = []
    for rows in (early, late):
        for r in (rows[:50], rows[50:]) if rows is early else [[r] for r in rows]:
            spark.createDataFrame(r, L.LOG).coalesce(1).write.mode("append").parquet(at("log"))
        query = ended(L.append(L.timing_changes(events(), keep=3600), at("changes"), at("c")))
        held.append([p.stateOperators[0].numRowsTotal if len(p.stateOperators) else None for p in query.recentProgress][-1])
    assert spark.read.parquet(at("changes")).count() == 50
    assert held[0] >= 50 and held[1] < 50, held


def test_lines_of_a_run(spark, tmp_path):
    """The files that a run writes."""
    line = spark.createDataFrame([("r", "j", "default", "parse", "stage_started", "2026-01-01T00:00:00.5+00:00", '{"payload":{"attempt":{"sample_id":"s","task_id":"t"}}}')], "run_id string, job_id string, lane string, stage string, event string, timestamp string, payload string")
    line.write.json(str(tmp_path / "e"))
    assert ended(L.append(L.log_lines(spark, str(tmp_path / "e")), str(tmp_path / "out"), str(tmp_path / "c")))
    r = spark.read.parquet(str(tmp_path / "out")).first()
    assert (r.sample_id, r.task_id, r.seq % 4) == ("s", "t", 0) and r.seq // 4 == 1767225600_500_000


def test_state_is_of_groups_and_not_of_jobs(spark, tmp_path):
    """However many jobs there are, a batch reads and writes the state of some groups; what it gives is that of the batch rules."""
    at = lambda n: str(tmp_path / n)
    rows, batch = log(spark, 5, jobs=900, n=6000)
    ended(L.append(L.timing_changes(L.once(delivered(spark, at("log"), rows, 5, files=3, reach=900), "1 hour")), at("changes"), at("c")))
    query = ended(L.append(L.timing_changes(L.once(spark.readStream.schema(L.LOG).parquet(at("log")), "1 hour")), at("more"), at("c2")))
    want = plain(E.stage_timing(batch), "job_id", "stage", "latency_us")
    assert len(want) > 700
    for out in ("changes", "more"):
        assert plain(L.timing_of(spark.read.parquet(at(out))), "job_id", "stage", "latency_us") == want
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) < 600


def test_jobs_of_one_group_are_cleared_apart(spark, tmp_path):
    """An old job goes and a newer one of its group stays: its output is timed from the start before."""
    at = lambda n: str(tmp_path / n)
    parts = [
        [(0, "r", "old", "parse", E.STARTED, T0, None, None), (1, "r", "new", "parse", E.STARTED, T0 + timedelta(hours=3), None, None), (2, "r", None, "parse", E.STARTED, T0 + timedelta(hours=3), None, None)],
        [(3, "r", "other", "parse", E.STARTED, T0 + timedelta(hours=3, seconds=30), None, None)],
        [(4, "r", j, "parse", E.OUTPUT, T0 + timedelta(hours=3, seconds=60), None, None) for j in ("old", "new", None)],
    ]
    for part in parts:  # each in a call of its own: the watermark moves between them
        spark.createDataFrame(part, L.LOG).coalesce(1).write.mode("append").parquet(at("log"))
        events = L.once(spark.readStream.schema(L.LOG).option("maxFilesPerTrigger", 1).parquet(at("log")), "10 seconds")
        ended(L.append(L.timing_changes(events, keep=3600, groups=1), at("changes"), at("c")))
    assert sorted((str(r.job_id), r.rev, r.latency_us, r.outputs, r.total_us) for r in spark.read.parquet(at("changes")).collect()) == [("None", 1, 60_000_000, 1, 60_000_000), ("new", 1, 60_000_000, 1, 60_000_000)]


def test_merging_frames_equals_going_through_events():
    """Pairs, later starts and changes, batch after batch, against plain Python."""
    import pandas as pd

    kinds = {"job_id": "string", "stage": "string", "event": "object", "seq": "Int64", "us": "Int64"}
    n = lambda x: None if x is pd.NA else x if isinstance(x, str) else int(x)
    for seed in range(12):
        rng, held = random.Random(seed), {}
        pairs, later = L._unpacked(None, L._PAIRS), L._unpacked(None, L._LATER)
        for _ in range(5):
            events = [(rng.choice((None, "a", "b", "c")), rng.choice("pt"), rng.choice((E.STARTED, E.OUTPUT)), rng.randrange(50), rng.randrange(10**6)) for _ in range(rng.randrange(1, 20))]
            want = []
            for key in {e[:2] for e in events}:
                starts, out, latency, rev = held.get(key, (set(), None, None, 0))
                starts = starts | {e[3:] for e in events if e[:2] == key and e[2] == E.STARTED}
                out = max([e[3:] for e in events if e[:2] == key and e[2] == E.OUTPUT] + [out] * (out is not None), default=None)
                start = max((s for s in starts if out and s[0] < out[0]), default=None)
                now = out[1] - start[1] if start else None
                if now is not None and now != latency:
                    rev += 1
                    want.append((*key, rev, now, latency))
                held[key] = {s for s in starts if s == start or out is None or s[0] > out[0]}, out, now, rev
            pairs, later, changed = L.merged(pairs, later, pd.DataFrame(events, columns=list(kinds)).astype(kinds))
            pairs, later = L._unpacked(L._packed(pairs, L._PAIRS), L._PAIRS), L._unpacked(L._packed(later, L._LATER), L._LATER)
            assert sorted((repr(tuple(map(n, r))) for r in changed[["job_id", "stage", "rev", "latency", "was"]].itertuples(index=False))) == sorted(map(repr, want))
            assert len(pairs) == len(held)
