"""Evaluation runs as streams: files of jobs go in, each stage of a registry is a streaming query of its own that hands its batches on, results are upserted by key.

Delivery is at least once: a batch may run again after a failure; it then writes the same rows, and what it had put in place stays.
"""

from __future__ import annotations

import importlib
import os
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..functions.extract import parse_attempts
from ..functions.sandbox import tasks_for
from ..operators import events as E
from ..operators import outcomes as O
from ..operators.stats import numbered
from ..plans.jobs import test_attempts
from ..schemas import ATTEMPTS, PARSE_OUTCOMES, SEED_SOURCES, TEST_OUTCOMES, cast_to
from ..sources import attempts as A
from ..sources.sinks import export_run
from ..sources.versions import Table, claim, claimed, delete, moved, names
from ..staging import scratch, shared_root, staged
from .control import ACTIVE, STALE_SECONDS, Busy, Control, StopAsked
from .progress import Measured, Progress, Stalled, Window

JOBS = "run_id STRING, lane STRING, repeat BIGINT, step_index INT, pipeline_id STRING, payload STRING"
HANDLERS = "evalmill.streaming.runs"
#: A stage gets attempts, the outcomes of the stages before it by name, and the options of the run; it gives outcomes by sample.
Stage = Callable[[DataFrame, dict[str, DataFrame], dict[str, Any]], DataFrame]


class AlreadySeeded(Exception):
    """A run is seeded once."""


@dataclass
class Registry:
    """Stage functions by name, in the order they run. A module with another `registry` is a set of handlers of its own."""

    stages: dict[str, Stage] = field(default_factory=dict)

    def stage(self, name: str) -> Callable[[Stage], Stage]:
        def keep(f: Stage) -> Stage:
            self.stages[name] = f
            return f

        return keep

    @staticmethod
    def load(module: str) -> Registry:
        found = getattr(importlib.import_module(module), "registry", None)
        if not isinstance(found, Registry) or not found.stages:
            raise ValueError(f"{module} has no registry with stages")
        return found


registry = Registry()


@registry.stage("parse")
def parse_stage(attempts: DataFrame, before: dict[str, DataFrame], options: dict[str, Any]) -> DataFrame:
    return parse_attempts(attempts)


@registry.stage("test")
def test_stage(attempts: DataFrame, before: dict[str, DataFrame], options: dict[str, Any]) -> DataFrame:
    narrow = staged(attempts.select("pos", "sample_id", "run_id", "task_id", "entry_point"), "test-attempts")  # texts stay where they are
    dealt = options.get("concurrency") or tasks_for(narrow.count(), attempts.sparkSession.sparkContext.defaultParallelism)
    return test_attempts(narrow, before["parse"], options["tasks"], options.get("timeout"), dealt)


test_stage.__test__ = False


def new_run_id(prefix: str = "run") -> str:
    return f"{prefix}-{uuid.uuid4().hex[:8]}"


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat()


def plain_path(path: str | None) -> str | None:
    """A local path as an absolute one without links and the home sign; paths of other file systems as they are."""
    return path if path is None or "://" in path else os.path.realpath(os.path.expanduser(path))


@dataclass
class Worker:
    """A streaming query of this process that works on a stage."""

    worker_id: str
    stage: str
    generation: int
    concurrency: int | None
    query: Any = None
    #: Held while a batch runs; stopping is set before it is waited for, so no batch begins after that.
    batch: Any = field(default_factory=threading.Lock)
    stopping: bool = False
    watch: Any = None

    def wait(self, seconds: float | None = None) -> bool:
        """Wait until it has ended and said so."""
        self.watch.join(seconds)
        return not self.watch.is_alive()

    def problem(self) -> str | None:
        """Why it has failed, if it has; a stop is no failure."""
        found = None if self.query.isActive else self.query.exception()
        return None if found is None or "StopAsked" in str(found) else str(found)[:2000]


@dataclass
class Run:
    """A run's folder: jobs in, results out, and metadata, events, progress, hand-offs, checkpoints and workers beside them. See stage_input() for how stages are joined.

    Several processes may use it at a time. init and seed are claims, a stage has one worker at a time, and results are a versioned table.
    """

    spark: SparkSession
    root: str
    run_id: str
    handlers: str = HANDLERS
    local: list[Worker] = field(default_factory=list)

    def __post_init__(self):
        self.progress = Progress(self.spark, self.path("progress"))
        self.table = Table(self.spark, self.path("results"))
        self.stages = list(Registry.load(self.handlers).stages)
        self._measured: Measured | None = None

    def path(self, *parts: str) -> str:
        return "/".join((self.root, self.run_id, *parts))

    # -- metadata: each initialisation is a generation of its own, with one seed

    def _initialised(self) -> int:
        return max((int(n.rpartition("-")[2]) for n in names(self.spark, self.path("meta")) if n.startswith("init-")), default=-1)

    def metadata(self) -> dict[str, Any] | None:
        n = self._initialised()
        if n < 0:
            return None
        seed = claimed(self.spark, self.path("meta", f"seed-{n:06d}"))
        return {"run_id": self.run_id, "init": claimed(self.spark, self.path("meta", f"init-{n:06d}")), "seed": {k: v for k, v in seed.items() if k != "jobs"} if seed else None}

    def init(self, overwrite: bool = False, **about: Any) -> dict[str, Any]:
        """Insert if absent, for one of several processes; overwriting replaces the metadata and clears the seed."""
        n = self._initialised()
        if n < 0 or overwrite:
            claim(self.spark, self.path("meta", f"init-{n + 1:06d}"), {"created": utc_now()} | about)
        return self.metadata()

    def seed(self, attempts: DataFrame, source: str = "in_memory", source_path: str | None = None) -> dict[str, Any]:
        """Publish attempts (with pos) as jobs: refused if the run isn't there or has a seed.

        Jobs are written out of sight; the seed is claimed with their folder in it, which one of several processes does; then the folder is renamed to where workers see it. What breaks off
        before the claim was nothing, and after it publish() ends the work, so jobs stand once.
        """
        n, there = self._initialised(), self.metadata()
        if there is None:
            raise ValueError(f"run {self.run_id} is not initialised")
        if there["seed"] is not None:
            self.publish()
            raise AlreadySeeded(self.run_id)
        if source not in SEED_SOURCES:
            raise ValueError(f"unknown seed source {source!r}")
        stamped = C.stamped(attempts, self.run_id)
        folder = f"seed-{n:06d}-{uuid.uuid4().hex}"
        with ThreadPoolExecutor(1) as beside, scratch(self.spark):
            digest = beside.submit(inheritable_thread_target(self.spark)(O.seed_digest(stamped).first))  # few tasks, which leave cores to the jobs
            placed = numbered(stamped, "__at")
            jobs = C.envelopes(placed.drop("pos"), F.lit(self.run_id), "eval", F.col("__at"))
            jobs.write.option("compression", "gzip").json(self.path("pending", folder))
            about = digest.result()
        seed = {"source": source, "source_path": plain_path(source_path), "expected_jobs": about.expected_jobs, "sample_ids_hash": about.sample_ids_hash, "task_ids": [t for t in about.task_ids.split(",") if t]}
        if not claim(self.spark, self.path("meta", f"seed-{n:06d}"), seed | {"jobs": folder}):
            delete(self.spark, self.path("pending", folder))
            raise AlreadySeeded(self.run_id)
        self.publish()
        return seed

    def publish(self) -> None:
        """Put the jobs of claimed seeds where workers see them; may be done again, and by any process."""
        for n in range(self._initialised() + 1):
            seed = claimed(self.spark, self.path("meta", f"seed-{n:06d}"))
            if seed and not names(self.spark, self.path("jobs", seed["jobs"])) and names(self.spark, self.path("pending", seed["jobs"])):
                moved(self.spark, self.path("pending", seed["jobs"]), self.path("jobs", seed["jobs"]))

    def expected(self) -> int:
        return ((self.metadata() or {}).get("seed") or {}).get("expected_jobs", 0)

    # -- stages

    def control(self, stage: str) -> Control:
        if stage not in self.stages:
            raise ValueError(f"unknown stage {stage!r}; known: {', '.join(self.stages)}")
        return Control(self.spark, self.path("control", stage))

    def stage_input(self, stage: str, options: dict[str, Any]) -> tuple[str, Any]:
        """Where a stage's rows come from, and their schema: the jobs for the first one; for the others the hand-off of the stage before, which has the jobs and, as a struct each, the
        outcomes of all stages so far. A batch is handed on by one rename, so the next stage's stream sees it as a whole and once."""
        k = self.stages.index(stage)
        schema = StructType.fromDDL(JOBS)
        if not k:
            return self.path("jobs", "*"), schema
        registered, done = Registry.load(self.handlers).stages, {}
        none = C.opened(self.spark.createDataFrame([], JOBS), ATTEMPTS).withColumnRenamed("repeat", "pos")
        for name in self.stages[:k]:
            done[name] = registered[name](none, dict(done), options)  # only its schema is looked at
            schema = schema.add(name, done[name].schema)
        return self.path("handoff", self.stages[k - 1], "*"), schema

    def start(self, tasks: DataFrame, stage: str, timeout: float | None = None, max_files: int = 64, trigger: dict[str, Any] | None = None, concurrency: int | None = None, stale_seconds: float = STALE_SECONDS) -> Worker:
        """A worker for a stage: a streaming query with a checkpoint of the stage's own, which tells it what is left. It runs until it is stopped, here or in another process; refused if the stage has a worker."""
        self.publish()
        control, options = self.control(stage), {"tasks": tasks, "timeout": timeout, "concurrency": concurrency}
        me = f"w-{uuid.uuid4().hex[:8]}"
        at, schema = self.stage_input(stage, options)
        g = control.begin({"worker_id": me, "run_id": self.run_id, "stages": [stage], "concurrency": concurrency or self.spark.sparkContext.defaultParallelism}, stale_seconds)
        worker = Worker(me, stage, g, concurrency)
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("maxFileAge", "36500d")
        stream = (stream.parquet if self.stages.index(stage) else stream.json)(at)

        def batch(rows: DataFrame, n: int) -> None:
            with worker.batch:
                if worker.stopping or not control.allowed(g):
                    worker.stopping = True
                    raise StopAsked(f"worker {me}")
                if not self.progress.counted(stage, n):
                    with scratch(self.spark):
                        self._batch(worker, rows, n, options)

        try:
            if self._measured is None:
                self._measured = Measured(self.progress)
                self.spark.streams.addListener(self._measured)
            writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", self.path("checkpoint", stage))
            worker.query = writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
        except BaseException as e:
            control.end(g, "failed", str(e)[:2000])
            raise
        self._measured.stages[str(worker.query.id)] = stage
        worker.watch = threading.Thread(target=self._watch, args=(worker, control), daemon=True)
        worker.watch.start()
        self.local.append(worker)
        return worker

    def _watch(self, worker: Worker, control: Control, poll: float = 0.5) -> None:
        """Keep a worker's heartbeat, stop it between two batches when that is asked for, and say how it ended."""
        while worker.query.isActive:
            control.beat(worker.generation)
            if worker.stopping or not control.allowed(worker.generation):
                worker.stopping = True
                with worker.batch:  # the batch that runs comes to its end
                    pass
                worker.query.stop()
                break
            time.sleep(poll)
        problem = worker.problem()
        control.end(worker.generation, "failed" if problem else "stopped", problem)

    def _batch(self, worker: Worker, rows: DataFrame, n: int, options: dict[str, Any]) -> None:
        """One batch of a stage: outcomes, then results (of the last stage), events and hand-off, each put in place as a whole, and at last its counts. A batch that is broken off runs again and
        writes the same; what stands already stays."""
        stage, before = worker.stage, self.stages[: self.stages.index(worker.stage)]
        began, last = time.time(), stage == self.stages[-1]
        if rows.rdd.getNumPartitions() < (cores := self.spark.sparkContext.defaultParallelism):
            rows = staged(rows.repartition(cores), "batch-rows")  # few files, which are no more than so many tasks can read: dealt to all cores once
        # rows and attempts have all texts, so where tasks are enough they are read again from the jobs or the hand-off in place of being copied; keys and outcomes are small beside them
        attempts = C.opened(rows.select(*StructType.fromDDL(JOBS).names), ATTEMPTS).withColumnRenamed("repeat", "pos")
        about = F.col("provenance.source").alias("provenance_source"), F.coalesce("provenance.occurrence_count", F.lit(1)).alias("occurrence_count")
        keys = staged(attempts.select("pos", "sample_id", "task_id", *about), "batch-keys")
        dealt = attempts.repartition(worker.concurrency) if worker.concurrency else attempts
        so_far = staged(rows.select(*before), "batch-before") if before else rows
        done = {name: so_far.select(f"`{name}`.*").where("sample_id is not null").dropDuplicates(["sample_id"]) for name in before}
        out = staged(Registry.load(self.handlers).stages[stage](dealt, done, options), f"batch-{stage}")
        if self.control(stage).generation() != worker.generation:
            raise StopAsked(f"worker {worker.worker_id} was replaced")
        one = out.dropDuplicates(["sample_id"])
        told = [lambda: self._put(self._events(stage, keys, one, began, last).write.option("compression", "gzip").json, "events", f"{stage}-{n:012d}"), lambda: self._put(out.write.option("compression", "gzip").json, "outcomes", stage, f"batch-{n:012d}")]
        if last:
            told.append(lambda: self.table.upsert(one.join(keys.select("sample_id", "provenance_source", "occurrence_count").dropDuplicates(["sample_id"]), "sample_id").withColumn("pos", F.lit(n).cast("long")).dropDuplicates(["run_id", "sample_id"])))
        with ThreadPoolExecutor(len(told) + 2) as beside:  # small jobs, whose time is mostly that of a job: all at once
            go = lambda f: beside.submit(inheritable_thread_target(self.spark)(f))
            jobs, kinds = go(keys.count), go(keys.select("sample_id").join(one, "sample_id").groupBy("outcome_kind").count().collect) if "outcome_kind" in out.columns else None
            for f in [go(f) for f in told]:
                if e := f.exception():
                    raise e.with_traceback(None)  # without the thread's frames, so that a worker's problem still tells its end
        if not last:
            placed = keys.select(F.col("pos").alias("repeat"), "sample_id").join(one.select("sample_id", F.struct(*one.columns).alias(stage)), "sample_id", "left").drop("sample_id")
            self._put(rows.join(placed, "repeat").write.option("compression", "zstd").parquet, "handoff", stage, f"batch-{n:012d}")  # the last one, as the next stage goes on from it
        by_kind = {r.outcome_kind: r["count"] for r in kinds.result()} if kinds else {}
        self.progress.count(stage, n, {"worker_id": worker.worker_id, "concurrency": worker.concurrency or self.spark.sparkContext.defaultParallelism, "jobs": jobs.result(), "kinds": by_kind, "batch_seconds": time.time() - began})

    def _put(self, write: Callable[[str], None], *parts: str) -> None:
        """Write a folder out of sight and rename it into its place, unless it stands there already."""
        if names(self.spark, self.path(*parts)):
            return
        beside = self.path("pending", uuid.uuid4().hex)
        write(beside)
        moved(self.spark, beside, self.path(*parts))

    def _events(self, stage: str, attempts: DataFrame, one: DataFrame, began: float, last: bool) -> DataFrame:
        """Start and output of a stage, and for the last one the end of every job with its records; a stage's output is as late as its sample took."""
        start = F.timestamp_micros(F.lit(int(began * 1e6)))
        record = F.to_json(F.struct(*one.columns), {"ignoreNullFields": "false"})
        end = F.timestamp_micros((F.lit(int(began * 1e6)) + F.coalesce("latency_ms", F.lit(0.0)) * 1000).cast("long"))
        own = attempts.select("pos", "sample_id", "task_id").join(one.select("sample_id", record.alias("record"), end.alias("end")), "sample_id")
        attempt = F.struct(F.struct("sample_id", "task_id").alias("attempt"))
        kinds = [(E.STARTED, start, F.to_json(F.struct(attempt.alias("payload")))), (E.OUTPUT, F.col("end"), F.concat(F.lit('{"step_record":'), F.col("record"), F.lit("}")))]
        if last:
            kinds.append((E.TERMINAL, F.col("end"), F.concat(F.lit('{"payload":'), F.to_json(attempt), F.lit(f',"step_records":{{"{stage}":'), F.col("record"), F.lit("}}"))))
        said = F.array(*(F.struct(F.lit(kind).alias("event"), F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"), payload.alias("payload")) for kind, at, payload in kinds))
        lines = own.select("pos", F.explode(said).alias("e"))  # a job's lines stay together and in order
        return lines.select(F.lit(self.run_id).alias("run_id"), F.concat(F.lit(f"{self.run_id}-"), F.col("pos").cast("string")).alias("job_id"), F.lit("default").alias("lane"), F.lit(stage).alias("stage"), "e.event", "e.timestamp", "e.payload")

    # -- workers of all processes

    def workers(self, stage: str | None = None, stale_seconds: float = STALE_SECONDS) -> list[dict[str, Any]]:
        """All workers, by their start; one that should run and was silent too long is stale."""
        found = [w for s in self.stages if stage in (None, s) for w in self.control(s).workers(stale_seconds)]
        return sorted(found, key=lambda w: w["started"])

    def stop(self, worker_id: str | None = None, stage: str | None = None, seconds: float = 0.0) -> list[dict[str, Any]]:
        """Ask workers of any process to stop, by id or by stage, or all. Each ends once its batch is done; what isn't done stays for the next one. Waits for them so many seconds."""
        if worker_id and stage:
            raise ValueError("stop by worker or by stage, not by both")
        chosen = [w for w in self.workers(stage) if w["status"] in (*ACTIVE, "stale") and (worker_id is None or w["worker_id"] == worker_id)]
        if worker_id and not chosen:
            raise ValueError(f"no running worker {worker_id}")
        for w in chosen:
            self.control(w["stages"][0]).ask(w["generation"])
        for w in chosen:
            if seconds:
                self.control(w["stages"][0]).gone(w["generation"], seconds)
        return [self.control(w["stages"][0]).worker(w["generation"]) for w in chosen]

    def replace(self, tasks: DataFrame, stage: str, concurrency: int, seconds: float = 600.0, stale_seconds: float = STALE_SECONDS, **more: Any) -> Worker:
        """Stop the worker of a stage, wherever it runs, wait until its batch is done, and start one with another concurrency here. Other stages go on."""
        control = self.control(stage)
        if g := control.generation():
            control.ask(g)
            if not control.gone(g, seconds, stale_seconds):
                raise TimeoutError(f"the worker of stage {stage} did not stop in {seconds} s")
        return self.start(tasks, stage, concurrency=concurrency, stale_seconds=stale_seconds, **more)

    def start_all(self, tasks: DataFrame, **more: Any) -> list[Worker]:
        """Workers for all stages, the later ones first."""
        return [self.start(tasks, s, **more) for s in E.start_order(self.stages)]

    def wait(self, target: str = "terminal", timeout: float | None = None, poll: float = 0.5, stall_seconds: float | None = None, jobs: int | None = None) -> dict[str, Any]:
        """Wait until all expected jobs (or so many of them) have ended, or a stage has done them; the status then. A worker of this process that fails is an error, and so is, if asked for, a silence of all stages."""
        stage = self.stages[-1] if target == "terminal" else target
        began, end = time.time(), None if timeout is None else time.monotonic() + timeout
        while True:
            done, expected = self.progress.jobs(stage).get(stage, 0), self.expected()
            if expected and done >= (expected if jobs is None else min(jobs, expected)):
                return self.status()
            for w in self.local:
                if problem := w.problem():
                    raise RuntimeError(f"worker {w.worker_id} failed: {problem}")
            if stall_seconds is not None and self.progress.silent(since=began) > stall_seconds:
                raise Stalled(f"run {self.run_id}: no batch ended for {stall_seconds} s, {done} of {expected} jobs are done")
            if end is not None and time.monotonic() >= end:
                raise TimeoutError(f"run {self.run_id} has {done} of {expected} jobs after {timeout} s")
            time.sleep(poll)

    def work(self, tasks: DataFrame, stages: list[str] | None = None, wait_seconds: float = 7200, **more: Any) -> None:
        """Workers of this process for some stages, or all, until these have done all expected jobs or are stopped from elsewhere."""
        chosen = [self.start(tasks, s, **more) for s in E.start_order(stages or self.stages)]
        end = time.monotonic() + wait_seconds
        try:
            while any(w.watch.is_alive() for w in chosen):
                if any(w.problem() for w in chosen) or all(self.progress.jobs(w.stage).get(w.stage, 0) >= self.expected() for w in chosen if w.watch.is_alive()):
                    break
                if time.monotonic() >= end:
                    raise TimeoutError(f"run {self.run_id} did not end in {wait_seconds} s")
                time.sleep(0.3)
        finally:
            for w in chosen:
                w.stopping = True
            for w in chosen:
                w.wait()
        for w in chosen:
            if (found := self.control(w.stage).worker(w.generation))["status"] == "failed":
                raise RuntimeError(f"worker {w.worker_id} failed: {found['problem']}")

    def run_once(self, attempts: DataFrame, tasks: DataFrame, timeout: float | None = None, wait_seconds: float = 7200) -> DataFrame:
        """Init, seed, run to the end; the results."""
        self.init()
        seed = self.seed(attempts)
        if seed["expected_jobs"]:
            self.work(tasks, None, wait_seconds, timeout=timeout)
        ended = self.progress.jobs(self.stages[-1]).get(self.stages[-1], 0)
        if ended < seed["expected_jobs"]:
            raise RuntimeError(f"run {self.run_id}: {ended} of {seed['expected_jobs']} jobs ended")
        return self.results()

    # -- what a run gives; nothing here writes into it

    def results(self) -> DataFrame:
        found = self.table.read()
        if found is None:
            raise ValueError(f"run {self.run_id} has no results")
        return found

    def events(self) -> DataFrame:
        return A.events(self.spark, self.path("events", "*"), self.run_id)

    def attempts(self) -> DataFrame:
        """The seeded attempts in the order of their jobs."""
        return C.opened(self.spark.read.schema(JOBS).json(self.path("jobs", "*")), ATTEMPTS).withColumnRenamed("repeat", "pos")

    def status(self) -> dict[str, Any]:
        """Expected jobs, jobs that have ended, their outcomes by kind, jobs done by stage, and the active workers; from the rows of progress."""
        last, active = self.stages[-1], [w for w in self.workers() if w["status"] in ACTIVE]
        done = self.progress.jobs()
        return {"expected_jobs": self.expected(), "terminals": done.get(last, 0), "kinds": self.progress.kinds(last), "stages": done, "active_workers": len(active), "active_concurrency": sum(w["concurrency"] for w in active)}

    def report(self) -> dict[str, Any]:
        """The whole report of the run, from its events and outcomes."""
        with scratch(self.spark):  # the log and the jobs are read once: the parts of the report look at them some ten times, but never at the texts
            events = staged(self.events(), "report-events")
            flat = staged(C.flattened(self.attempts().drop("decoder_input", "raw_output")), "report-attempts")
            parsed = staged(A.parse_from_events(events).drop("extracted_code", "code_eval"), "report-parse")
            tested = staged(A.tests_from_events(events).drop("extracted_code", "test_case_results"), "report-test")
            return E.metrics_report(self.run_id, self.expected(), events, flat, parsed, tested)

    def export(self, path: str | None = None) -> dict[str, str]:
        """The run's bundle: attempts, outcomes, manifest, and the report if all jobs have ended."""
        results = cast_to(self.results(), TEST_OUTCOMES)
        parsed = cast_to(self.spark.read.schema(PARSE_OUTCOMES).json(self.path("outcomes", "parse", "*")), PARSE_OUTCOMES)
        return export_run(path or self.path("export"), self.attempts(), parsed.dropDuplicates(["sample_id"]), results, self.metadata() or {}, self.report())

    # -- tuning

    def tune(
        self, tasks: DataFrame, stage: str, start: int, most: int, measure_seconds: float = 60.0, warm_up_seconds: float = 15.0, least_samples: int = 5, on_step: Callable[[dict[str, Any]], None] | None = None, **more: Any
    ) -> dict[str, Any]:
        """The best concurrency of a stage while the run goes on: its worker is replaced by one with twice the concurrency, what it does while it warms up is passed over, and a window of
        progress is measured, until the rate falls or gains too little or no jobs are left. The best one works on."""
        control = self.control(stage)
        left = lambda: self.progress.jobs(stage).get(stage, 0) >= self.expected()
        if not (g := control.generation()) or control.worker(g)["concurrency"] != start or control.worker(g)["status"] not in ACTIVE:
            self.replace(tasks, stage, start, **more)
        return sweep(lambda n: self.progress.window(stage, measure_seconds, until=left), start, most, least_samples=least_samples, swap=lambda n: self.replace(tasks, stage, n, **more), warm_up_seconds=warm_up_seconds, on_step=on_step)


def sweep(
    measure: Callable[[int], Window], start: int, most: int, factor: int = 2, threshold: float = 0.1, least_samples: int = 5,
    swap: Callable[[int], None] | None = None, warm_up_seconds: float = 0.0, on_step: Callable[[dict[str, Any]], None] | None = None, apply_best: bool = True, dry_run: bool = False,
) -> dict[str, Any]:
    """The best parallelism, as a report: workers grow by factor until the rate of a reliable step falls or gains too little.

    swap changes the number of workers; its effect is measured after the warm-up. A step in which too few jobs ended is not reliable:
    it is neither the best nor what the next one is compared with.
    """
    steps: list[dict[str, Any]] = []
    workers, best, previous, reason = start, (start, None), None, f"reached {most} workers"
    while workers <= most:
        swapped = swap is not None and workers != start and not dry_run
        if swapped:
            swap(workers)
            time.sleep(warm_up_seconds)
        w = Window(0, 0, 0.0) if dry_run else measure(workers)
        rate = (w.terminals_after - w.terminals_before) / w.seconds if w.seconds > 0 else 0.0
        good = not dry_run and w.terminals_after - w.terminals_before >= least_samples
        step = {
            "workers": workers, "swapped": swapped, "terminals_before": w.terminals_before, "terminals_after": w.terminals_after, "warmup_seconds": warm_up_seconds if swapped else 0.0,
            "measure_seconds": w.seconds, "samples_per_second": rate, "infra_error_before": w.infra_before, "infra_error_after": w.infra_after, "infra_error_delta": w.infra_after - w.infra_before, "reliable": good,
        }
        steps.append(step)
        if on_step is not None:
            on_step(step)
        if good:
            if best[1] is None or rate > best[1]:
                best = workers, rate
            if previous is not None and rate < previous:
                reason = f"slower with {workers} workers"
                break
            if previous and (rate - previous) / previous < threshold:
                reason = f"little gain with {workers} workers: {(rate - previous) / previous:.1%}"
                break
            previous = rate
        workers *= factor
    if apply_best and swap is not None and not dry_run and steps and steps[-1]["workers"] != best[0]:
        swap(best[0])
    return {"steps": steps, "best_workers": best[0], "best_samples_per_second": best[1] or 0.0, "stop_reason": reason}


__all__ = ["AlreadySeeded", "Busy", "Progress", "Registry", "Run", "Stalled", "Window", "Worker", "new_run_id", "plain_path", "registry", "shared_root", "sweep", "utc_now"]
