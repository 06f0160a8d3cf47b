"""Timing and throughput from lifecycle events.

events: seq (unique, in list order), run_id, job_id, stage, event, ts (timestamp), task_id, sample_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STARTED, OUTPUT, TERMINAL = "stage_started", "stage_output", "terminal"


def of_run(events: DataFrame, run_id: str) -> DataFrame:
    return events.where(F.col("run_id") == run_id)


def micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def stage_timing(events: DataFrame) -> DataFrame:
    """Per job and stage: microseconds from the latest start before the last output to that output."""
    rows = events.where(F.col("event").isin(STARTED, OUTPUT)).select("job_id", "stage", "event", "seq", micros("ts").alias("us"))
    before = Window.partitionBy("job_id", "stage").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.last(F.when(F.col("event") == STARTED, F.col("us")), True).over(before))
    done = rows.where((F.col("event") == OUTPUT) & F.col("start").isNotNull())
    return done.groupBy("job_id", "stage").agg(F.max_by(F.col("us") - F.col("start"), "seq").alias("latency_us"))


def job_tasks(events: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """Per job the task of its last terminal event that tells one, if need be through the attempt."""
    rows = events.where(F.col("event") == TERMINAL)
    if attempts is not None:
        side = attempts.groupBy("sample_id").agg(F.max_by("task_id", "pos").alias("__task"))
        rows = rows.join(side, "sample_id", "left").withColumn("task_id", F.coalesce("task_id", "__task"))
    return rows.where(F.col("task_id").isNotNull()).groupBy("job_id").agg(F.max_by("task_id", "seq").alias("task_id"))


def _rate(count: Column, us: Column) -> Column:
    return F.when(us > 0, count.cast("double") / (us.cast("double") / F.lit(1e6))).otherwise(F.lit(0.0))


def throughput(timing: DataFrame, tasks: DataFrame) -> DataFrame:
    """Service rates per stage (task_id null) and per task and stage, in one aggregation."""
    rows = timing.join(tasks, "job_id", "left").withColumn("task", F.coalesce("task_id", F.lit("unknown")))
    out = rows.groupingSets([["stage"], ["task", "stage"]], "task", "stage").agg(F.count("*").alias("outputs"), F.sum("latency_us").alias("total_us"))
    return out.select(F.col("task").alias("task_id"), "stage", "outputs", "total_us", _rate(F.col("outputs"), F.col("total_us")).alias("samples_per_second"))


def wall(events: DataFrame) -> DataFrame:
    """Terminal events, and seconds from the first start to the last of them; zero if either is missing."""
    last, first = F.max(F.when(F.col("event") == TERMINAL, micros("ts"))), F.min(F.when(F.col("event") == STARTED, micros("ts")))
    return events.agg(F.count_if(F.col("event") == TERMINAL).alias("terminal_count"), F.coalesce(last - first, F.lit(0)).alias("wall_us"))


def overall(one: DataFrame) -> DataFrame:
    return one.withColumns({"wall_seconds": F.col("wall_us") / 1e6, "overall_samples_per_second": _rate(F.col("terminal_count"), F.col("wall_us"))})


def proof_outcomes(attempts: DataFrame, parse: DataFrame, test: DataFrame) -> DataFrame:
    """Per task: seeded, parsed, tested and passed. Outcomes of any run count."""
    from .outcomes import with_outcome

    rows = with_outcome(with_outcome(attempts, parse, "p", False), test, "t", False)
    tested = F.coalesce(F.col("t.outcome_kind") == "tested", F.lit(False))
    return rows.groupBy("task_id").agg(
        F.count("*").alias("seeded"), F.count_if(F.coalesce("p.parse_success", F.lit(False))).alias("parse_success"), F.count_if(tested).alias("tested"),
        F.count_if(tested & F.coalesce("t.all_tests_passed", F.lit(False))).alias("all_tests_passed"),
    )


def proof_kinds(attempts: DataFrame, test: DataFrame) -> DataFrame:
    from .outcomes import with_outcome

    rows = with_outcome(attempts, test, "t", False).where(F.col("t").isNotNull())
    return rows.groupBy(F.col("t.outcome_kind").alias("outcome_kind")).agg(F.count("*").alias("row_count"), F.sum("provenance_occurrence_count").cast("long").alias("weighted_count"))


def status(events: DataFrame) -> DataFrame:
    """Per stage: starts, outputs, terminal events and jobs."""
    return events.groupBy("stage").agg(F.count_if(F.col("event") == STARTED).alias("started"), F.count_if(F.col("event") == OUTPUT).alias("completed"), F.count_if(F.col("event") == TERMINAL).alias("terminals"), F.countDistinct("job_id").alias("jobs"))


def stage_completions(events: DataFrame, stage: str, known: tuple[str, ...] = ("parse", "test")) -> DataFrame:
    if stage not in known:
        raise ValueError(f"unknown stage {stage!r}; known: {', '.join(known)}")
    done = TERMINAL if stage == known[-1] else OUTPUT
    return events.where((F.col("event") == done) & ((F.col("stage") == stage) | F.lit(done == TERMINAL))).agg(F.count("*").alias("completions"))


def windows(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """Terminal events per tumbling window."""
    return events.where(F.col("event") == TERMINAL).groupBy(F.window(F.col("ts").cast("timestamp"), size).alias("w")).agg(F.count("*").alias("terminals")).select(F.col("w.start").alias("window_start"), "terminals")


def stalls(events: DataFrame, gap_us: int, by: Column) -> DataFrame:
    """Gaps between terminal events that exceed a limit. by: a coarse time bucket, so that no task sorts the whole log.

    The last event of the last bucket before is carried over from a table of one row per bucket.
    """
    rows = events.where(F.col("event") == TERMINAL).select(by.alias("bucket"), "seq", micros("ts").alias("us"))
    ends = rows.groupBy("bucket").agg(F.max(F.struct("us", "seq")).alias("end"))
    carried = ends.select("bucket", F.lag("end.us").over(Window.orderBy("bucket")).alias("before"))
    own = F.lag("us").over(Window.partitionBy("bucket").orderBy("us", "seq"))
    out = rows.withColumn("own", own).join(carried, "bucket").withColumn("gap_us", F.col("us") - F.coalesce("own", "before"))
    return out.where(F.col("gap_us") > gap_us).select("seq", "gap_us")


def reliable(before: Column, after: Column, least: int = 5) -> Column:
    """Did enough jobs end within a window to trust its rate?"""
    return (after - before) >= least


def worker_status(workers: DataFrame, now: Column, stale_us: int) -> DataFrame:
    """workers: worker_id, stage, status, concurrency, heartbeat (timestamp). status becomes stale where a worker that should run was silent too long."""
    silent = F.col("status").isin("running", "stop_requested") & (F.unix_micros(now) - micros("heartbeat") > stale_us)
    return workers.withColumn("status", F.when(silent, F.lit("stale")).otherwise(F.col("status")))


def worker_roll_up(workers: DataFrame) -> DataFrame:
    """Per stage: workers, those active with their concurrency, stale ones and those asked to stop."""
    active = F.col("status").isin("running", "stop_requested")
    return workers.groupBy("stage").agg(
        F.count("*").alias("workers"), F.count_if(active).alias("active_workers"), F.coalesce(F.sum(F.when(active, F.col("concurrency"))), F.lit(0)).cast("long").alias("active_concurrency"),
        F.count_if(F.col("status") == "stale").alias("stale_workers"), F.count_if(F.col("status") == "stop_requested").alias("stop_requested"),
    )


def start_order(stages: list[str]) -> list[str]:
    """Later stages start first, so that what an earlier one gives finds a worker."""
    return list(reversed(stages))


def sweep(steps: DataFrame, threshold: float = 0.1) -> DataFrame:
    """steps: workers, rate, reliable. Gain over the last reliable step, the best rate so far, and where a sweep would stop."""
    up = Window.orderBy("workers")  # a sweep has some ten steps
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rows = steps.withColumn("previous_rate", F.last(F.when(F.col("reliable"), F.col("rate")), True).over(before))
    gain = F.when(F.col("reliable") & (F.col("previous_rate") > 0), (F.col("rate") - F.col("previous_rate")) / F.col("previous_rate"))
    reason = F.when(F.col("reliable") & (F.col("rate") < F.col("previous_rate")), F.lit("regression")).when(gain < threshold, F.lit("diminishing returns"))
    rows = rows.withColumns({"gain": gain, "reason": reason})
    rows = rows.withColumn("stopped_before", F.coalesce(F.max(F.col("reason").isNotNull()).over(before), F.lit(False)))
    best = F.max(F.when(F.col("reliable") & ~F.col("stopped_before"), F.col("rate"))).over(up.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("best_rate", F.coalesce(best, F.lit(0.0)))


def metrics_report(run_id: str, expected: int, events: DataFrame, attempts: DataFrame, parse: DataFrame, test: DataFrame, listed: int = 100_000) -> dict:
    """The whole report of a run, as a document of aggregates. All missing ids are counted, and listed up to a bound; untested_ids() has them all."""
    from .outcomes import untested_ids

    mine = of_run(events, run_id)
    one = overall(wall(mine)).first()
    rates = throughput(stage_timing(mine), job_tasks(mine, attempts)).collect()
    by_task: dict[str, dict[str, float]] = {}
    for r in rates:
        if r.task_id is not None:
            by_task.setdefault(r.task_id, {})[r.stage] = r.samples_per_second
    kinds = proof_kinds(attempts, test).collect()
    tasks = proof_outcomes(attempts, parse, test).collect()
    untested = untested_ids(attempts, test)
    missing = [r.sample_id for r in untested.limit(listed).collect()]
    return {
        "run_id": run_id, "expected_jobs": expected, "terminal_count": one.terminal_count, "complete": one.terminal_count >= expected, "wall_seconds": one.wall_seconds,
        "throughput": {"overall_samples_per_second": one.overall_samples_per_second, "by_stage": {r.stage: r.samples_per_second for r in rates if r.task_id is None}, "by_task": by_task},
        "outcomes": {
            "attempt_count": sum(r.seeded for r in tasks), "parse_success_count": sum(r.parse_success for r in tasks), "tests_ran_count": sum(r.tested for r in tasks), "all_tests_passed_count": sum(r.all_tests_passed for r in tasks),
            "outcome_kind_counts": {r.outcome_kind: r.row_count for r in kinds}, "outcome_kind_counts_weighted": {r.outcome_kind: r.weighted_count for r in kinds},
            "by_task": {r.task_id: {k: r[k] for k in ("seeded", "parse_success", "tested", "all_tests_passed")} for r in tasks}, "missing_test_sample_ids": missing, "missing_test_count": len(missing) if len(missing) < listed else untested.count(),
        },
    }
