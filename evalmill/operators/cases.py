"""Logic over case results, and the routing of samples to tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What messages of a broken sandbox hold, in lower case.
INFRA_MARKERS = ("fork failed", "worker timed out", "worker exited", "worker returned no output", "missing results list")


def infra_message(m: Column) -> Column:
    low = F.lower(m)
    out = F.lit(False)
    for marker in INFRA_MARKERS:
        out = out | low.contains(marker)
    return F.coalesce(out, F.lit(False))


def pass_rate(cases: Column) -> Column:
    return F.try_divide(F.size(F.filter(cases, lambda c: F.coalesce(c["passed"], F.lit(False)))).cast("double"), F.size(cases))


def reclassified(cases: Column) -> Column:
    """infra_error if no case passed and all have one and the same message, one that a broken sandbox gives; else tested."""
    text = F.transform(cases, lambda c: F.coalesce(F.nullif(c["error"], F.lit("")), F.nullif(c["compile_error"], F.lit(""))))
    none_passed = ~F.exists(cases, lambda c: F.coalesce(c["passed"], F.lit(False)))
    broken = (F.size(cases) > 0) & none_passed & F.forall(text, lambda m: m.isNotNull()) & (F.size(F.array_distinct(text)) == 1) & infra_message(F.get(text, F.lit(0)))
    return F.when(F.coalesce(broken, F.lit(False)), F.lit("infra_error")).otherwise(F.lit("tested"))


def routed(attempts: DataFrame, parse: DataFrame, tasks: DataFrame) -> DataFrame:
    """What becomes of each attempt before any code runs: route is skipped, internal_error or execute.

    parse: one row per sample. tasks: task_id, shape, task_entry_point, problem (why the suite can't be read, else null). An attempt with code whose
    task is unknown or whose suite is broken is an internal error, with the message. The task side is a small dimension; it is left
    to adaptive execution to broadcast it.
    """
    side = parse.select("sample_id", F.struct(*(c for c in parse.columns if c != "sample_id")).alias("p"))
    dimension = tasks.select("task_id", F.struct("shape", "task_entry_point", "problem").alias("k"))
    rows = attempts.join(side, "sample_id", "left").join(dimension, "task_id", "left")
    p, k = F.col("p"), F.col("k")
    failed = ~F.coalesce(p["parse_success"], F.lit(False))
    uncoded = p["extracted_code"].isNull()
    wrong = (
        F.when(p.isNull(), F.lit("missing_parse_outcome")).when(failed | uncoded, None)
        .when(k.isNull(), F.concat(F.lit("unknown task: "), F.col("task_id"))).otherwise(k["problem"])
    )
    supported = F.coalesce(k["shape"] == "inputs_results", F.lit(False))
    route = F.when(wrong.isNotNull(), "internal_error").when(failed | uncoded | ~supported, "skipped").otherwise("execute")
    reason = (
        F.when(wrong.isNotNull(), None)
        .when(failed, F.coalesce(F.nullif(p["skip_reason"], F.lit("")), F.lit("parse_failed")))
        .when(uncoded, F.lit("parse_failed"))
        .when(~supported, F.lit("unsupported_test_shape"))
    )
    code = F.when((route == "execute") | (reason == "unsupported_test_shape"), p["extracted_code"])
    entry = F.when(route == "execute", F.col("entry_point")).when(reason == "unsupported_test_shape", k["task_entry_point"])
    return rows.select(
        "pos", "sample_id", F.coalesce(F.nullif(p["run_id"], F.lit("")), F.col("run_id")).alias("run_id"), "task_id", route.alias("route"), reason.alias("skip_reason"),
        wrong.alias("internal_error"), entry.alias("entry_point"), code.alias("extracted_code"), F.coalesce(p["parse_success"], F.lit(False)).alias("parse_success"),
    )


def batch_tally(test: DataFrame) -> DataFrame:
    kind, passed = F.col("outcome_kind"), F.coalesce("all_tests_passed", F.lit(False))
    return test.agg(*(F.count_if(kind == k).alias(f"{k}_count") for k in ("skipped", "tested", "infra_error", "internal_error")), F.count_if((kind == "tested") & passed).alias("pass_count"), F.count_if((kind == "tested") & ~passed).alias("fail_count"))


def until_failure(test: DataFrame) -> DataFrame:
    """Rows up to the first internal error, as a run that fails fast would give them."""
    stop = test.where("outcome_kind = 'internal_error'").agg(F.min("pos").alias("__stop"))  # one row
    return test.join(F.broadcast(stop)).where(F.col("__stop").isNull() | (F.col("pos") <= F.col("__stop"))).drop("__stop")


def mean_latency(rows: DataFrame, c: str = "latency_ms") -> DataFrame:
    return rows.agg(F.coalesce(F.avg(c), F.lit(0.0)).alias("mean_latency_ms"))


def zipped(inputs: Column, results: Column) -> Column:
    """Cases from equally long arrays; other lengths are an error."""
    same = F.when(F.size(inputs) != F.size(results), F.raise_error(F.lit("inputs and results differ in length")).cast("int")).otherwise(F.size(inputs))
    return F.when(same >= 0, F.zip_with(inputs, results, lambda a, b: F.struct(a.alias("input_value"), b.alias("expected_output"))))
