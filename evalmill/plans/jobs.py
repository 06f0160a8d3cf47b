"""The stages as jobs over tables: parse, test, analyse; and the streaming run that chains the first two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sandbox
from ..functions.extract import parse_attempts
from ..operators import cases as K
from ..operators import outcomes as O
from ..operators.outcomes import first
from ..operators.stats import numbered
from ..schemas import TEST_OUTCOMES, cast_to, checked_outcomes
from ..sources.versions import Table
from ..staging import staged


def test_attempts(attempts: DataFrame, parse: DataFrame, tasks: DataFrame, timeout: float | None = None, parallel: int | None = None) -> DataFrame:
    """Test outcomes of all attempts. The router is relational, so only rows that can run reach the sandbox."""
    suites = sandbox.task_cases(tasks.select("task_id", F.col("entry_point").alias("task_entry_point"), "test"))
    routed = K.routed(attempts if "pos" in attempts.columns else attempts.withColumn("pos", F.lit(None).cast("long")), O.latest(parse, "sample_id") if "pos" in parse.columns else parse, suites.select("task_id", "shape", "task_entry_point", "problem"))
    todo = routed.where("route = 'execute'").join(suites.select("task_id", "cases"), "task_id")
    ran = sandbox.run_tests(todo, timeout, parallel)
    plain = routed.select("sample_id", "run_id", "task_id", "parse_success", "entry_point", "extracted_code", "skip_reason", "route", F.col("internal_error").alias("__problem"))
    done = plain.join(ran, "sample_id", "left")
    out = done.withColumns({
        "outcome_kind": F.when(F.col("route") == "execute", F.col("outcome_kind")).otherwise(F.col("route")),
        "skipped": F.col("route") == "skipped", "tests_ran": F.coalesce("tests_ran", F.lit(False)),
        "test_case_results": F.coalesce("test_case_results", F.array().cast(f"array<struct<{sandbox._CASE}>>")),
        "internal_error": F.coalesce("internal_error", "__problem"),
    })
    return checked_outcomes(cast_to(out, TEST_OUTCOMES))


#: Samples of a frame that is tested and committed as a whole.
FRAME = 10_000


def test_in_frames(attempts: DataFrame, parse: DataFrame, tasks: DataFrame, table: Table, timeout: float | None = None, parallel: int | None = None, frame: int = FRAME, fail_fast: bool = False, most: int | None = None) -> DataFrame:
    """test_attempts frame by frame, each committed to a table (keyed by sample_id) when it is done; samples that the table has already are left out. So a batch that broke off goes on where it
    was, and a sample whose outcome stands is not run again. fail_fast: no frame begins after one with an internal error. most: frames of this call at most. The table's outcomes.

    attempts have a pos; sample ids that repeat are one sample.
    """
    done = table.read()
    todo = first(attempts, "sample_id") if done is None else first(attempts, "sample_id").join(done.select("sample_id"), "sample_id", "left_anti")
    todo = staged(numbered(todo, "__n").withColumn("__frame", F.expr(f"__n div {frame}")), "frames")
    frames = (todo.agg(F.max("__frame")).first()[0] or 0) + 1 if todo.take(1) else 0
    parsed = staged(parse, "frames-parsed")
    for k in range(frames if most is None else min(frames, most)):
        own = todo.where(F.col("__frame") == k).drop("__n", "__frame")
        dealt = parallel or sandbox.tasks_for(own.count(), own.sparkSession.sparkContext.defaultParallelism)
        out = staged(test_attempts(own, parsed.join(own.select("sample_id"), "sample_id", "left_semi"), tasks, timeout, dealt), "frame-outcomes")
        table.upsert(out.withColumn("pos", F.lit(0).cast("long")))
        if fail_fast and out.where("outcome_kind = 'internal_error'").take(1):
            break
    found = table.read()
    return cast_to(attempts.limit(0) if found is None else found, TEST_OUTCOMES)


test_in_frames.__test__ = False


def analyse(attempts: DataFrame, parse: DataFrame, test: DataFrame, path: str) -> dict:
    """Enriched rows with quartiles, slices and summary, written to path. attempts are flat, with pos."""
    from ..sources.sinks import export_analysis

    sized = O.measured(attempts)
    return export_analysis(O.with_quartile(O.enriched(sized, parse, test), sizes=sized), path)


__all__ = ["analyse", "parse_attempts", "test_attempts", "test_in_frames"]
