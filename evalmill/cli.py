"""Command line: python -m evalmill.cli COMMAND ... . Each command is a thin wrapper of a job."""

from __future__ import annotations

import argparse
import json
import time
import uuid
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import session
from .functions import columns as C
from .functions import display
from .functions.extract import parse_attempts
from .operators import slices as S
from .operators import stats as T
from .plans import jobs
from .sources import attempts as A
from .sources import sinks
from .sources.documents import write_document
from .sources.tasks import Profiles, snapshot, stub_attempts
from .staging import exists, staged


def preflight(spark: SparkSession, *paths: str, handlers: str | None = None, root: str | None = None) -> list[str]:
    """What is missing before a run: paths that can't be seen, handlers that can't be loaded, a shared folder; and, of a root, renames of folders as a run needs them."""
    from .sources.versions import claim, claimed, delete
    from .streaming.runs import Registry

    wrong = [f"no such path: {path}" for path in filter(None, paths) if not exists(spark, path)]
    if handlers:
        try:
            Registry.load(handlers)
        except (ImportError, ValueError) as e:
            wrong.append(f"no handlers: {e}")
    if not spark.sparkContext.master.startswith("local") and not spark.conf.get("spark.checkpoint.dir", None):
        wrong.append("spark.checkpoint.dir is not set")
    if root:
        probe = f"{root}/preflight/{uuid.uuid4().hex}"
        try:
            if [claim(spark, f"{probe}/once", {"n": n}) for n in (1, 2)] != [True, False] or claimed(spark, f"{probe}/once") != {"n": 1}:
                wrong.append(f"a folder that is renamed twice doesn't stay as it was: {root}")
        except Exception as e:  # noqa: BLE001
            wrong.append(f"cannot write: {root}: {str(e).splitlines()[0]}")
        delete(spark, probe)
    return wrong


def _load(spark: SparkSession, args: argparse.Namespace):
    tasks = snapshot(spark, args.tasks) if getattr(args, "tasks", None) else None
    return tasks, A.attempts(spark, args.attempts) if getattr(args, "attempts", None) else None


def import_pool(spark: SparkSession, args: argparse.Namespace) -> Any:
    """A pool file, a dedup file, or both joined, to an attempts export."""
    tasks = snapshot(spark, args.tasks)
    if args.source.endswith(".parquet"):
        rows = A.pool_parquet(spark, args.source, tasks, args.limit)
    elif args.pool:
        rows = A.pool_dedup_with_parquet(spark, args.source, args.pool, tasks, args.limit)
    else:
        rows = A.pool_dedup(spark, args.source, tasks, limit=args.limit)
    sinks.write_attempts(rows, args.out)
    flat = C.flattened(A.attempts(spark, args.out).drop("pos")).withColumn("pos", F.monotonically_increasing_id())
    stats, top = T.attempt_stats(flat).first().asDict(), T.top_tasks(flat).collect()
    return display.attempt_summary(stats, {r.source: r.row_count for r in T.source_breakdown(flat).collect()}, [(r.task_id, r.row_count) for r in top])


def parse(spark: SparkSession, args: argparse.Namespace) -> Any:
    _, rows = _load(spark, args)
    out = parse_attempts(T.slice_limit(rows, args.limit))
    sinks.write_json_lines(out, args.out)
    done = spark.read.schema(out.schema).json(args.out).agg(F.count("*").alias("n"), F.count_if("parse_success").alias("ok"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("ms")).first()
    return f"parsed {done.n}, {done.ok} with code, mean {done.ms:.1f} ms"


def test(spark: SparkSession, args: argparse.Namespace) -> Any:
    """Test outcomes, committed frame by frame beside the output (<out>.frames), so that a call that broke off goes on where it was; at the end as lines."""
    from .operators.cases import batch_tally
    from .sources.versions import Table, delete

    tasks, rows = _load(spark, args)
    table = Table(spark, f"{args.out}.frames", ("sample_id",))
    if args.resume != "yes":
        delete(spark, table.path)
    out = jobs.test_in_frames(T.slice_limit(rows, args.limit), A.parse_outcomes(spark, args.parse), tasks, table, args.timeout, frame=args.frame, fail_fast=args.fail_fast == "yes")
    sinks.write_json_lines(out, args.out)
    return json.dumps(batch_tally(spark.read.schema(out.schema).json(args.out)).first().asDict())


def analyse(spark: SparkSession, args: argparse.Namespace) -> Any:
    _, rows = _load(spark, args)
    flat = C.flattened(T.slice_limit(rows, args.limit)).drop("provenance_extra_json")
    summary = jobs.analyse(flat, A.parse_outcomes(spark, args.parse), A.test_outcomes(spark, args.test), args.out)
    return json.dumps({k: summary[k] for k in ("attempt_count", "tested_pass_count", "tested_fail_count", "correctness_pass_rate")})


def outcomes(spark: SparkSession, args: argparse.Namespace) -> Any:
    """The outcome kinds of an analysis bundle, with attempts, weights and passes; of none, no lines."""
    found = S.outcome_table(A.bundle_outcomes(spark, args.bundle)).collect()  # a row per kind
    return "\n".join(json.dumps(r.asDict()) for r in sorted(found, key=lambda r: (-r.row_count, r.outcome_kind or "")))


def run(spark: SparkSession, args: argparse.Namespace) -> Any:
    """One step of a run's life, or all: preflight, init, seed, start, replace, stop, workers, wait, status, export, show, vacuum."""
    from .streaming.runs import Run, new_run_id

    r = Run(spark, args.root, args.run_id or new_run_id(), args.handlers)
    tasks, rows = _load(spark, args)
    step = args.step
    if step == "preflight":
        return "ready"  # main() has looked at paths, handlers and root
    if step in ("init", "all"):
        r.init(overwrite=args.overwrite == "yes")
    if step in ("seed", "all"):
        r.seed(rows, "attempts_path", args.attempts)
    if step in ("start", "all"):  # one stage, or all; until their jobs are done or they are stopped from elsewhere
        r.work(tasks, [args.stage] if args.stage else None, args.wait, timeout=args.timeout, concurrency=args.concurrency)
    if step == "replace":
        stage = args.stage or r.stages[-1]
        worker = r.replace(tasks, stage, args.concurrency or spark.sparkContext.defaultParallelism, timeout=args.timeout)
        try:
            while worker.watch.is_alive() and r.progress.jobs(stage).get(stage, 0) < r.expected():
                worker.wait(1.0)
        finally:
            worker.stopping = True
            worker.wait()
    if step == "stop":
        return display.worker_table(r.stop(args.worker, args.stage, min(args.wait, 600.0)))
    if step == "workers":
        return display.worker_table(r.workers(args.stage))
    if step == "wait":
        return json.dumps(r.wait(args.target, args.wait, stall_seconds=args.stall))
    if step == "show":
        return display.run_text(r.metadata() or {"run_id": r.run_id})
    if step == "vacuum":
        return f"{r.table.vacuum()} folders deleted"
    if step in ("export", "all"):
        paths = r.export(args.out)
        if step == "export":
            return display.pretty(paths)
    return json.dumps(r.status())


def tune(spark: SparkSession, args: argparse.Namespace) -> Any:
    """The parallelism of a stage: doubled until the rate falls or gains too little. With a root and a run, of the run while it goes on; else of the test stage over the given files."""
    from .streaming.runs import Run, Window, sweep

    tasks, rows = _load(spark, args)
    if args.root and args.run_id:
        r = Run(spark, args.root, args.run_id)
        report = r.tune(tasks, args.stage or r.stages[-1], args.start, args.most, args.measure, args.warm_up, args.least, timeout=args.timeout)
        for w in r.local:
            if w.watch.is_alive():  # the best worker goes on until the jobs are done
                while w.watch.is_alive() and r.progress.jobs(w.stage).get(w.stage, 0) < r.expected():
                    w.wait(1.0)
                w.stopping = True
                w.wait()
    else:
        rows = staged(T.slice_limit(rows, args.limit), "tune-attempts")
        parsed = staged(A.parse_outcomes(spark, args.parse), "tune-parsed")

        def measure(n: int) -> Window:
            began = time.perf_counter()
            done = jobs.test_attempts(rows, parsed, tasks, args.timeout, n).agg(F.count("*").alias("n"), F.count_if(F.col("outcome_kind") == "infra_error").alias("bad")).first()
            return Window(0, done.n, time.perf_counter() - began, 0, done.bad)

        report = sweep(measure, args.start, args.most, least_samples=args.least, dry_run=args.dry_run == "yes")
    if args.out:
        write_document(spark, report, args.out)
    return display.sweep_table(report)


def spot_check(spark: SparkSession, args: argparse.Namespace) -> Any:
    """The first pool and the first fresh attempt of a task, to be compared by eye."""
    flat = C.flattened(A.attempts(spark, args.attempts))
    return display.spot_check_text(args.task, {k: r.asDict() for k, r in T.both_sides(flat, args.task).items()})


def generate(spark: SparkSession, args: argparse.Namespace) -> Any:
    """A batch of attempts without a model, from the tasks' own solutions."""
    made = stub_attempts(spark, snapshot(spark, args.tasks), Profiles.load(args.file).resolve(args.id), args.run_id)
    sinks.write_attempts(made, args.out)
    return f"wrote {A.attempts(spark, args.out).count()} attempts"


def profiles(spark: SparkSession, args: argparse.Namespace) -> Any:
    p = Profiles.load(args.file)
    return json.dumps(p.resolve(args.id)) if args.id else "\n".join(p.ids())


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="evalmill", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(name: str, f, *options: str, **defaults: Any) -> None:
        sub = commands.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        for o in options:
            sub.add_argument(f"--{o}", required=o not in defaults, default=defaults.get(o), type=type(defaults[o]) if defaults.get(o) is not None else int if o in ("limit", "concurrency") else float if o == "stall" else str)
        sub.set_defaults(f=f)

    command("import-pool", import_pool, "source", "tasks", "out", "pool", "limit", pool=None, limit=None)
    command("parse", parse, "attempts", "out", "limit", limit=None)
    command("test", test, "attempts", "parse", "tasks", "out", "limit", "timeout", "frame", "fail_fast", "resume", limit=None, timeout=30.0, frame=jobs.FRAME, fail_fast="no", resume="no")
    command("analyse", analyse, "attempts", "parse", "test", "out", "limit", limit=None)
    command("outcomes", outcomes, "bundle")
    command("run", run, "root", "run_id", "step", "attempts", "tasks", "timeout", "wait", "overwrite", "handlers", "concurrency", "stage", "worker", "target", "out", "stall", run_id=None, step="all", attempts=None, tasks=None, timeout=30.0, wait=28_800.0, overwrite="no", handlers="evalmill.streaming.runs", concurrency=None, stage=None, worker=None, target="terminal", out=None, stall=None)
    command("tune", tune, "attempts", "parse", "tasks", "limit", "timeout", "start", "most", "least", "dry_run", "out", "root", "run_id", "stage", "measure", "warm_up", attempts=None, parse=None, root=None, run_id=None, stage=None, measure=60.0, warm_up=15.0, limit=None, timeout=30.0, start=2, most=64, least=5, dry_run="no", out=None)
    command("spot-check", spot_check, "attempts", "task")
    command("generate", generate, "tasks", "file", "id", "run_id", "out", run_id="run-stub")
    command("profiles", profiles, "file", "id", id=None)
    args = parser.parse_args(argv)
    spark = session.get()
    wrong = preflight(spark, *(getattr(args, k, None) for k in ("source", "tasks", "attempts", "parse", "pool") if isinstance(getattr(args, k, None), str)), handlers=getattr(args, "handlers", None), root=args.root if getattr(args, "step", None) == "preflight" else None)
    if wrong:
        raise SystemExit("\n".join(wrong))
    print(args.f(spark, args))


if __name__ == "__main__":
    main()
