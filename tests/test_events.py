import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evalmill.operators import cases as K
from evalmill.operators import events as E

LOG = "seq long, run_id string, job_id string, stage string, event string, ts timestamp, task_id string, sample_id string"
T0 = datetime(2026, 1, 1)


def log(spark, *rows):
    return spark.createDataFrame([(i, "r", j, s, e, T0 + timedelta(seconds=t), None, "s1") for i, (j, s, e, t) in enumerate(rows)], LOG)


def test_one_job(spark):
    e = log(spark, ("j", "parse", "stage_started", 0), ("j", "parse", "stage_output", 0.5), ("j", "test", "stage_started", 1.0), ("j", "test", "stage_output", 3.0), ("j", "test", "terminal", 3.0))
    attempts = spark.createDataFrame([(0, "s1", "HumanEval/0", 1)], "pos long, sample_id string, task_id string, provenance_occurrence_count long")
    parse = spark.createDataFrame([(0, "s1", True)], "pos long, sample_id string, parse_success boolean")
    test = spark.createDataFrame([(0, "s1", "tested", True)], "pos long, sample_id string, outcome_kind string, all_tests_passed boolean")
    r = E.metrics_report("r", 1, e, attempts, parse, test)
    assert r["complete"] and r["wall_seconds"] == 3.0 and r["throughput"]["by_stage"] == {"parse": 2.0, "test": 0.5}
    assert r["throughput"]["by_task"] == {"HumanEval/0": {"parse": 2.0, "test": 0.5}} and r["outcomes"]["tests_ran_count"] == 1 and r["outcomes"]["missing_test_count"] == 0


def test_timing_equals_a_fold(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice(("parse", "test")), rng.choice(("stage_started", "stage_output", "terminal")), i) for i in range(120)]
    start, want = {}, {}
    for j, s, e, t in rows:
        if e == "stage_started":
            start[j, s] = t
        elif e == "stage_output" and (j, s) in start:
            want[j, s] = (t - start[j, s]) * 1_000_000
    assert {(x.job_id, x.stage): x.latency_us for x in E.stage_timing(log(spark, *rows)).collect()} == want


def test_no_events(spark):
    e = log(spark, ("j", "parse", "stage_started", 0)).limit(0)
    assert E.overall(E.wall(e)).first().overall_samples_per_second == 0.0


def test_sweep(spark):
    steps = spark.createDataFrame([(2, 5.08, True), (4, 6.45, True), (8, 6.60, True)], "workers int, rate double, reliable boolean")
    got = {r.workers: r for r in E.sweep(steps).collect()}
    assert got[4].reason is None and got[8].reason == "diminishing returns" and got[8].best_rate == 6.60
    with pytest.raises(ValueError, match="unknown stage"):
        E.stage_completions(log(spark, ("j", "parse", "terminal", 0)), "nope")


CASE = "a array<struct<passed:boolean,error:string,compile_error:string>>"


@pytest.mark.parametrize(
    ("cases", "want"),
    [
        ([(False, "worker exited with rc=137: OOM", None)] * 2, "infra_error"),
        ([(False, None, "SyntaxError: a"), (False, None, "SyntaxError: b")], "tested"),
        ([(False, "worker exited", None), (True, None, None)], "tested"),
        ([(False, "ValueError: x", None)] * 2, "tested"),
        ([(False, "worker exited", None), (False, None, None)], "tested"),
        ([(False, "invalid JSON from worker", None)], "tested"),
        ([], "tested"),
    ],
)
def test_reclassification(spark, cases, want):
    assert spark.createDataFrame([(cases,)], CASE).select(K.reclassified(F.col("a"))).first()[0] == want


def test_router(spark):
    task_of = lambda i: "t1" if i < 4 else f"t{i - 2}"
    attempts = spark.createDataFrame([(i, f"s{i}", "r", task_of(i), "f") for i in range(8)], "pos long, sample_id string, run_id string, task_id string, entry_point string")
    parse = [("s0", "", True, "c", None), ("s1", None, False, None, "bad"), ("s2", None, False, None, None), ("s3", "x", True, None, None), ("s4", None, True, "c", None), ("s5", None, True, "c", None), ("s6", None, True, "c", None)]
    parse = spark.createDataFrame(parse, "sample_id string, run_id string, parse_success boolean, extracted_code string, skip_reason string")
    tasks = spark.createDataFrame([("t1", "inputs_results", "g1", None), ("t2", "inputs_ref_func", "g2", None), ("t3", None, "g3", "ValueError: no check function")], "task_id string, shape string, task_entry_point string, problem string")
    got = [(r.route, r.skip_reason, r.internal_error, r.run_id, r.entry_point) for r in K.routed(attempts, parse, tasks).orderBy("pos").collect()]
    assert got == [
        ("execute", None, None, "r", "f"), ("skipped", "bad", None, "r", None), ("skipped", "parse_failed", None, "r", None), ("skipped", "parse_failed", None, "x", None), ("skipped", "unsupported_test_shape", None, "r", "g2"),
        ("internal_error", None, "ValueError: no check function", "r", None), ("internal_error", None, "unknown task: t4", "r", None), ("internal_error", None, "missing_parse_outcome", "r", None),
    ]


def test_fail_fast_and_zip(spark):
    t = spark.createDataFrame([(0, "tested"), (1, "internal_error"), (2, "tested")], "pos long, outcome_kind string")
    assert K.until_failure(t).count() == 2 and K.until_failure(t.where("pos <> 1")).count() == 2
    d = spark.createDataFrame([([1], [1, 2])], "a array<int>, b array<int>")
    with pytest.raises(Exception, match="differ in length"):
        d.select(K.zipped(F.col("a"), F.col("b"))).collect()
