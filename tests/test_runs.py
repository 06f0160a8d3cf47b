"""Runs: stages as queries of their own, workers of several processes, seeds that stand once, progress and tuning while a run goes on."""

import os
import subprocess
import sys
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalmill.functions.extract import parse_attempts
from evalmill.plans.jobs import test_attempts
from evalmill.schemas import ATTEMPTS, TASKS
from evalmill.sources import versions as V
from evalmill.streaming import runs as R
from evalmill.streaming.control import Busy, Control
from evalmill.streaming.progress import Progress, Stalled
from evalmill.streaming.runs import AlreadySeeded, Registry, Run, Window, sweep

test_attempts.__test__ = False
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ADD = "def add(a, b):\n    return a + b\n"
CHECK = "def check(candidate):\n    inputs = [[1, 2], [3, 4]]\n    results = [3, 7]\n"


@pytest.fixture
def tasks(spark):
    return spark.createDataFrame([("t1", "add", "p", "s", CHECK), ("t2", "add", "p", "s", "def check(c):\n    inputs = [1]\n")], TASKS)


def attempts_of(spark, *texts):
    made = [(f"s{i}", None, t, "add", "describe", x, ("pool", None, None, None, None, None, 2, None, {})) for i, (t, x) in enumerate(texts)]
    return spark.createDataFrame(made, ATTEMPTS).withColumn("pos", F.monotonically_increasing_id())


def seeded(spark, path, run_id, *texts):
    """A run with a file for each job, so that a batch may have one."""
    run = Run(spark, path, run_id)
    run.init()
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "1")
    try:
        run.seed(attempts_of(spark, *texts))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    return run


def once(run):
    """No job lost or doubled: counts, results and events tell the same."""
    events = Counter((r.job_id, r.stage, r.event) for r in run.events().select("job_id", "stage", "event").collect())
    assert set(events.values()) <= {1}
    return len({j for j, _, e in events if e == "terminal"})


def test_stream_equals_batch(spark, tasks, tmp_path):
    a = attempts_of(spark, ("t1", ADD), ("t1", "nothing"), ("t2", ADD))
    run = Run(spark, str(tmp_path), "run-1")
    with pytest.raises(ValueError, match="not initialised"):
        run.seed(a)
    got = {(r.sample_id, r.outcome_kind) for r in run.run_once(a, tasks, 10.0).collect()}
    assert sorted(r.repeat for r in spark.read.json(run.path("jobs", "*")).collect()) == [0, 1, 2]
    assert got == {(r.sample_id, r.outcome_kind) for r in test_attempts(a, parse_attempts(a), tasks, 10.0).collect()}
    with pytest.raises(AlreadySeeded):
        run.seed(a)
    run.work(tasks, timeout=10.0)  # nothing new: the checkpoints know what is done
    assert run.status() == {"expected_jobs": 3, "terminals": 3, "kinds": {"tested": 1, "skipped": 2}, "stages": {"parse": 3, "test": 3}, "active_workers": 0, "active_concurrency": 0}
    assert once(run) == 3
    report = run.report()
    assert report["complete"] and report["outcomes"]["tests_ran_count"] == 1 and set(report["throughput"]["by_stage"]) == {"parse", "test"} and set(report["throughput"]["by_task"]) == {"t1", "t2"}
    assert run.init(overwrite=True)["seed"] is None and run.table.read().count() == 3
    # a run without jobs ends at once
    empty = Run(spark, str(tmp_path), "run-0")
    with pytest.raises(ValueError, match="no results"):
        empty.run_once(a.limit(0), tasks)


def test_test_workers_are_replaced_while_parse_goes_on(spark, tasks, tmp_path):
    run = seeded(spark, str(tmp_path), "run-2", *(("t1", ADD if k % 2 else "nothing") for k in range(12)))
    parse = run.start(tasks, "parse", max_files=2)
    first = run.start(tasks, "test", 10.0, max_files=1, concurrency=2)
    with pytest.raises(Busy, match=first.worker_id):
        run.start(tasks, "test")
    assert sorted((w["stages"][0], w["status"]) for w in run.workers()) == [("parse", "running"), ("test", "running")] and run.workers("parse")[0]["worker_id"] == parse.worker_id
    assert [w["status"] for w in run.workers("test", stale_seconds=-1)] == ["stale"]
    run.wait("parse", 120)
    second = run.replace(tasks, "test", 3, timeout=10.0, max_files=1)
    assert first.wait(5) and parse.watch.is_alive() and second.generation == 2
    status = run.wait(timeout=180, stall_seconds=120)
    assert status["terminals"] == 12 and status["kinds"] == {"tested": 6, "skipped": 6} and status["active_workers"] == 2
    for bad, why in ((lambda: run.stop("w", "test"), "not by both"), (lambda: run.stop("w"), "no running worker"), (lambda: run.replace(tasks, "nope", 1), "unknown stage")):
        with pytest.raises(ValueError, match=why):
            bad()
    assert {w["status"] for w in run.stop(seconds=60)} == {"stopped"} and run.stop() == []
    assert [(w["concurrency"], w["status"]) for w in run.workers("test")] == [(2, "stopped"), (3, "stopped")]
    assert once(run) == 12 and run.results().count() == 12
    assert {r["stage"] for r in run.progress.rows()} == {"parse", "test"} and run.progress.table().groupBy("stage").agg(F.sum("jobs")).count() == 2
    with pytest.raises(TimeoutError):
        Run(spark, str(tmp_path), "run-3").wait(timeout=0)


CHILD = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from evalmill.streaming.runs import Run
from evalmill.schemas import TASKS
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
tasks = spark.createDataFrame([("t1", "add", "p", "s", {check!r})], TASKS)
run = Run(spark, {path!r}, "r")
{body}
"""


def child(tmp_path, name, body, **env):
    (tmp_path / f"{name}.py").write_text(CHILD.format(root=ROOT, check=CHECK, path=str(tmp_path), body=body))
    return subprocess.Popen([sys.executable, str(tmp_path / f"{name}.py")], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, env=os.environ | {"PYTHONPATH": ROOT} | env)


def test_a_stop_and_a_replacement_from_another_process(spark, tasks, tmp_path):
    """The worker runs in a process of its own; this one stops and replaces it, and nothing is lost or doubled."""
    run = seeded(spark, str(tmp_path), "r", *(("t1", ADD) for _ in range(10)))
    theirs = child(tmp_path, "worker", "run.work(tasks, wait_seconds=240, timeout=10.0, max_files=1)\nprint('ended', run.status()['terminals'])")
    while run.progress.jobs("test").get("test", 0) < 2:
        assert theirs.poll() is None
        time.sleep(0.2)
    assert {w["status"] for w in run.stop(stage="parse", seconds=90)} == {"stopped"}
    done = run.progress.jobs("parse")["parse"]
    time.sleep(3)
    assert run.progress.jobs("parse")["parse"] == done < 10  # a stop is a stop, whatever batches come
    mine = run.replace(tasks, "test", 2, timeout=10.0)
    out, _ = theirs.communicate(timeout=120)
    assert theirs.returncode == 0 and out.startswith("ended")
    run.start(tasks, "parse")
    assert run.wait(timeout=180)["terminals"] == 10
    run.stop(seconds=60)
    assert mine.wait(10) and once(run) == 10 and run.results().where("outcome_kind = 'tested' and all_tests_passed").count() == 10
    assert [w["status"] for w in run.workers()] == ["stopped"] * 4


def test_two_processes_seed_at_once(spark, tmp_path):
    body = """
from evalmill.schemas import ATTEMPTS
from evalmill.streaming.runs import AlreadySeeded
import os, time
rows = spark.createDataFrame([(f"s{i}", None, "t1", "add", "d", "x", ("pool", None, None, None, None, None, 1, None, {})) for i in range(7)], ATTEMPTS)
from pyspark.sql import functions as F
rows = rows.withColumn("pos", F.monotonically_increasing_id())
run.init()
rows.count()
open(os.environ["READY"], "w").close()
while not os.path.exists(os.environ["GO"]):
    time.sleep(0.01)
try:
    run.seed(rows)
    print("seeded")
except AlreadySeeded:
    print("refused")
"""
    both = [child(tmp_path, f"seed{k}", body, READY=str(tmp_path / f"ready{k}"), GO=str(tmp_path / "go")) for k in range(2)]
    while not all((tmp_path / f"ready{k}").exists() for k in range(2)):
        assert all(p.poll() is None for p in both)
        time.sleep(0.1)
    (tmp_path / "go").touch()
    assert sorted(p.communicate(timeout=120)[0].strip() for p in both) == ["refused", "seeded"]
    run = Run(spark, str(tmp_path), "r")
    assert run.metadata()["seed"]["expected_jobs"] == 7 and spark.read.json(run.path("jobs", "*")).count() == 7 and V.names(spark, run.path("pending")) == []
    assert V.names(spark, run.path("meta")) == ["init-000000", "seed-000000"]


@pytest.mark.parametrize(("step", "late"), [("claim", False), ("claim", True), ("moved", False), ("moved", True)])
def test_a_seed_that_breaks_off_leaves_no_doubled_jobs(spark, tmp_path, monkeypatch, step, late):
    run, rows = Run(spark, str(tmp_path), "r"), attempts_of(spark, ("t1", ADD), ("t1", "x"))
    run.init()
    with monkeypatch.context() as m:
        real = getattr(R, step)

        def stop(*a):
            if late:
                real(*a)
            raise KeyboardInterrupt

        m.setattr(R, step, stop)
        with pytest.raises(KeyboardInterrupt):
            run.seed(rows)
    try:
        run.seed(rows)
    except AlreadySeeded:
        pass
    assert run.metadata()["seed"]["expected_jobs"] == 2 and spark.read.json(run.path("jobs", "*")).count() == 2 and len(V.names(spark, run.path("jobs"))) == 1


@pytest.mark.parametrize("step", ["upsert", "events", "outcomes", "handoff", "count"])
def test_a_batch_that_breaks_off_runs_again(spark, tasks, tmp_path, monkeypatch, step):
    """After each thing that a batch puts in place: the next worker ends it, and every job is there once."""
    run = Run(spark, str(tmp_path), "r")
    run.init()
    run.seed(attempts_of(spark, ("t1", ADD), ("t1", "nothing")))
    with monkeypatch.context() as m:
        if step in ("upsert", "count"):
            on, name = (V.Table, "upsert") if step == "upsert" else (Progress, "count")
            real = getattr(on, name)
            m.setattr(on, name, lambda *a, real=real: (real(*a) if step == "upsert" else None, 1 / 0))
        else:
            real = Run._put
            m.setattr(Run, "_put", lambda self, write, *parts, real=real: (real(self, write, *parts), 1 / 0 if parts[0] == step else None))
        with pytest.raises(RuntimeError, match="division by zero"):
            run.work(tasks, wait_seconds=120, timeout=10.0)
    assert "failed" in {w["status"] for w in run.workers()}
    run.work(tasks, wait_seconds=120, timeout=10.0)
    assert run.status()["terminals"] == 2 and once(run) == 2 and run.results().count() == 2


def test_one_worker_at_a_time(spark, tmp_path):
    """Of many that begin at once one does; a newer generation fences off one that was thought dead."""
    control, won, go = Control(spark, str(tmp_path / "c")), [], threading.Barrier(5)

    def one(k):
        go.wait()
        try:
            won.append((k, control.begin({"worker_id": f"w{k}", "stages": ["s"], "concurrency": 1})))
        except Busy:
            pass

    several = [threading.Thread(target=one, args=(k,)) for k in range(5)]
    for t in several:
        t.start()
    for t in several:
        t.join()
    assert [g for _, g in won] == [1] and control.allowed(1) and control.worker(1)["status"] == "running"
    with pytest.raises(Busy):
        control.begin({"worker_id": "w"})
    assert control.begin({"worker_id": "w"}, stale_seconds=-1) == 2 and not control.allowed(1) and control.allowed(2)
    control.ask(2)
    assert not control.allowed(2) and control.worker(2)["status"] == "stop_requested" and not control.gone(2, 0.3)
    control.end(2, "stopped")
    control.end(2, "failed")
    assert control.worker(2)["status"] == "stopped" and control.gone(2, 0.3) and [w["status"] for w in control.workers(1e9)] == ["running", "stopped"]


def test_a_worker_that_was_replaced_writes_nothing(spark, tasks, tmp_path):
    run = Run(spark, str(tmp_path), "r")
    run.init()
    run.seed(attempts_of(spark, ("t1", "nothing")))
    worker = R.Worker("old", "parse", run.control("parse").begin({"worker_id": "old", "stages": ["parse"], "concurrency": 1}), None)
    run.control("parse").begin({"worker_id": "new", "stages": ["parse"], "concurrency": 1}, stale_seconds=-1)
    with pytest.raises(R.StopAsked):
        run._batch(worker, spark.read.schema(R.JOBS).json(run.path("jobs", "*")), 0, {"tasks": tasks})
    assert V.names(spark, run.path("handoff", "parse")) == [] and V.names(spark, run.path("events")) == [] and run.progress.rows() == []


def test_handlers_of_another_module(spark, tasks, tmp_path, monkeypatch):
    (tmp_path / "own_handlers.py").write_text("from evalmill.streaming.runs import Registry, parse_stage, test_stage\nfrom pyspark.sql import functions as F\nregistry = Registry()\nregistry.stage('parse')(parse_stage)\n@registry.stage('test')\ndef nothing(attempts, before, options):\n    return test_stage(attempts, before, options).withColumn('skip_reason', F.lit('own'))\n@registry.stage('last')\ndef last(attempts, before, options):\n    return before['test'].withColumn('skip_reason', F.concat('skip_reason', F.lit(' and last'), before['parse'].columns and F.lit('')))\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert list(Registry.load("own_handlers").stages) == ["parse", "test", "last"]
    with pytest.raises(ValueError, match="no registry"):
        Registry.load("json")
    run = Run(spark, str(tmp_path / "runs"), "r", "own_handlers")
    assert run.run_once(attempts_of(spark, ("t1", "nothing")), tasks, 10.0).first().skip_reason == "own and last"
    assert run.status()["stages"] == {"parse": 1, "test": 1, "last": 1}


def test_progress(spark, tmp_path):
    p = Progress(spark, str(tmp_path / "p"))
    assert p.rows() == [] and p.jobs() == {} and p.rate("test") == 0.0 and p.table().count() == 0
    for n, (worker, jobs) in enumerate((("a", 5), ("a", 10), ("a", 30), ("b", 7), ("b", 20))):
        assert p.count("test", n, {"worker_id": worker, "concurrency": 2, "jobs": jobs, "kinds": {"tested": jobs - 1, "infra_error": 1}})
        p.timed("test", n, 2.0)
    assert not p.count("test", 3, {"jobs": 99})  # a batch that runs again counts once
    assert p.jobs() == {"test": 72} and p.kinds("test") == {"tested": 67, "infra_error": 5}
    assert p.rate("test") == (10 + 30 + 20) / 6  # what each worker does first is its warm-up
    other, opened = Progress(spark, p.path), []
    real = V.claimed
    import evalmill.streaming.progress as module

    module.claimed = lambda *a: (opened.append(a), real(*a))[1]
    try:
        assert other.jobs() == p.jobs() and len(opened) == 10
        assert other.jobs() == p.jobs() and len(opened) == 10  # nothing is opened twice
        p.count("test", 5, {"worker_id": "b", "concurrency": 2, "jobs": 1})
        assert other.jobs()["test"] == 73 and len(opened) == 11
    finally:
        module.claimed = real
    w = p.window("test", 0.5, until=lambda: p.count("test", 6, {"worker_id": "b", "concurrency": 2, "jobs": 4, "kinds": {"infra_error": 2}}) is None)
    assert (w.terminals_before, w.terminals_after, w.infra_before, w.infra_after) == (73, 77, 5, 7) and w.seconds >= 0.5
    assert 0 <= p.silent() < 60 and p.silent("none", time.time() - 50) >= 50


def test_a_silent_run_is_an_alarm(spark, tasks, tmp_path):
    run = Run(spark, str(tmp_path), "r")
    run.init()
    run.seed(attempts_of(spark, ("t1", "nothing")))
    with pytest.raises(Stalled, match="0 of 1 jobs"):
        run.wait(stall_seconds=0.5, timeout=30)


def test_a_live_run_is_tuned(spark, tasks, tmp_path):
    """The sweep swaps the worker of the run while it goes on, passes over the warm-up, and leaves the best one at work."""
    slow = "import time\ndef add(a, b):\n    time.sleep(0.1)\n    return a + b\n"
    run = seeded(spark, str(tmp_path), "r", *(("t1", slow) for _ in range(40)))
    run.start(tasks, "parse")
    run.wait("parse", 120)
    steps = []
    report = run.tune(tasks, "test", 1, 2, measure_seconds=20.0, warm_up_seconds=1.0, least_samples=1, on_step=steps.append, timeout=10.0, max_files=1)
    assert [s["workers"] for s in report["steps"]][:1] == [1] and report["best_workers"] in (1, 2) and steps == report["steps"]
    assert steps[0]["terminals_after"] > steps[0]["terminals_before"] and steps[0]["reliable"]
    if len(steps) > 1:
        assert steps[1]["swapped"] and steps[1]["warmup_seconds"] == 1.0 and steps[1]["terminals_before"] >= steps[0]["terminals_after"]
    at_work = [w for w in run.workers("test") if w["status"] == "running"]
    assert [w["concurrency"] for w in at_work] == [report["best_workers"]]
    assert run.wait(timeout=180)["terminals"] == 40
    run.stop(seconds=60)
    assert once(run) == 40 and run.results().count() == 40


def test_sweep_stops():
    rates = {2: 5.08, 4: 6.45, 8: 6.60}
    swaps = []
    report = sweep(lambda n: Window(0, int(rates[n] * 100), 100.0, 0, n), 2, 16, swap=swaps.append)
    assert report["best_workers"] == 8 and report["stop_reason"].startswith("little gain with 8 workers") and len(report["steps"]) == 3
    assert swaps == [4, 8] and report["steps"][2]["infra_error_delta"] == 8
    # a step with too few jobs is neither the best nor compared with
    report = sweep(lambda n: Window(0, {2: 100, 4: 3, 8: 120, 16: 90}[n], 10.0), 2, 16, swap=swaps.append)
    assert [x["reliable"] for x in report["steps"]] == [True, False, True, True] and report["best_workers"] == 8 and report["stop_reason"].startswith("slower with 16") and swaps[-1] == 8
    assert sweep(lambda n: 1 / 0, 2, 8, dry_run=True)["best_samples_per_second"] == 0.0


def test_a_report_reads_jobs_and_events_once(spark, tasks, tmp_path, monkeypatch):
    """However many parts the report has, they don't read the run's files anew, and what they read in their place is gone after it."""
    run = Run(spark, str(tmp_path), "r")
    run.run_once(attempts_of(spark, ("t1", ADD), ("t1", "nothing"), ("t2", ADD)), tasks, 10.0)
    seen, real = [], R.E.metrics_report
    monkeypatch.setattr(R.E, "metrics_report", lambda *a, **b: (seen.extend(a[2:]), real(*a, **b))[1])
    report = run.report()
    assert report["complete"] and report["outcomes"]["parse_success_count"] == 2 and report["outcomes"]["tests_ran_count"] == 1
    assert len(seen) == 4 and all("Scan json" not in d._jdf.queryExecution().optimizedPlan().toString() and "/r/" not in d._jdf.queryExecution().executedPlan().toString() for d in seen)
    assert not {"decoder_input", "raw_output", "extracted_code"} & {c for d in seen[1:] for c in d.columns}


def test_a_wait_for_some_jobs_ends_before_all_are_done(spark, tasks, tmp_path):
    """replaced_run waits for the first batch of the test stage, not for all of parse."""
    run = seeded(spark, str(tmp_path), "r", *(("t1", ADD) for _ in range(4)))
    run.start(tasks, "parse", max_files=1, trigger={"availableNow": True})
    status = run.wait("parse", timeout=120, jobs=1)
    assert 1 <= status["stages"]["parse"] <= 4
    assert run.wait("parse", timeout=120, jobs=9)["stages"]["parse"] == 4  # no more than there are
    run.stop(seconds=60)
