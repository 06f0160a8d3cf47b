"""Pass rates by slice, summary and funnel over enriched rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import UNKNOWN, or_unknown

WEIGHT = "provenance_occurrence_count"
JOINT_LAMBDA = 0.001


def tested() -> Column:
    return F.coalesce(F.col("has_test_outcome") & (F.col("outcome_kind") == "tested"), F.lit(False))


def passed() -> Column:
    return tested() & F.coalesce(F.col("all_tests_passed"), F.lit(False))


def _sum_if(condition: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("long")


def measures() -> list[Column]:
    w = F.col(WEIGHT)
    return [
        F.count("*").alias("row_count"), F.coalesce(F.sum(w), F.lit(0)).cast("long").alias("weighted_count"),
        F.count_if(tested()).alias("tested_count"), _sum_if(tested(), w).alias("tested_weighted_count"),
        F.count_if(passed()).alias("pass_count"), _sum_if(passed(), w).alias("weighted_pass_count"),
    ]


def with_rates(df: DataFrame) -> DataFrame:
    return df.withColumns({"pass_rate": F.try_divide(F.col("pass_count").cast("double"), "tested_count"), "weighted_pass_rate": F.try_divide(F.col("weighted_pass_count").cast("double"), "tested_weighted_count")})


def slice_by(rows: DataFrame, key: Column) -> DataFrame:
    return with_rates(rows.groupBy(key.alias("slice_key")).agg(*measures())).orderBy("slice_key")


def slice_keys() -> dict[str, Column]:
    return {"by_source": F.col("provenance_source"), "by_model": or_unknown("provenance_model"), "by_task": F.col("task_id"), "by_compression_quartile": F.coalesce("compression_quartile", F.lit(UNKNOWN))}


def all_slices(rows: DataFrame) -> DataFrame:
    """The four slice tables in one aggregation with grouping sets: slice_name tells them apart."""
    keys = slice_keys()
    keyed = rows.select("*", *(c.alias(f"__{k}") for k, c in keys.items()))
    columns = [F.col(f"__{k}") for k in keys]
    sets = [[c] for c in columns]
    name = F.coalesce(*(F.when(F.grouping(c) == 0, k) for k, c in zip(keys, columns)))
    value = F.coalesce(*(F.when(F.grouping(c) == 0, c) for c in columns))
    out = keyed.groupingSets(sets, *columns).agg(name.alias("slice_name"), value.alias("slice_key"), *measures())
    return with_rates(out.drop(*(f"__{k}" for k in keys))).orderBy("slice_name", "slice_key")


def summary(rows: DataFrame) -> DataFrame:
    w = F.col(WEIGHT)
    out = rows.agg(
        F.count("*").alias("attempt_count"), F.count_if(passed()).alias("tested_pass_count"), F.count_if(tested() & ~passed()).alias("tested_fail_count"),
        F.try_divide(F.count_if(passed()).cast("double"), F.count_if(tested())).alias("correctness_pass_rate"),
        F.try_divide(_sum_if(passed(), w).cast("double"), _sum_if(tested(), w)).alias("correctness_pass_rate_weighted"),
    )
    return out


def outcome_kinds(rows: DataFrame) -> DataFrame:
    """How often each kind of test outcome occurs, plain and weighted."""
    return rows.where("has_test_outcome").groupBy("outcome_kind").agg(F.count("*").alias("row_count"), F.sum(WEIGHT).cast("long").alias("weighted_count")).orderBy("outcome_kind")


def funnel(rows: DataFrame) -> DataFrame:
    w = F.col(WEIGHT)
    steps = {"raw": F.lit(True), "parse_success": F.coalesce("parse_success", F.lit(False)), "tested": tested(), "all_tests_passed": passed()}
    return rows.agg(*(F.count_if(c).alias(f"{k}_count") for k, c in steps.items()), *(_sum_if(c, w).alias(f"{k}_weighted_count") for k, c in steps.items()))


def funnel_steps(rows: DataFrame) -> DataFrame:
    """The funnel as one row per step."""
    one, names = funnel(rows), ("raw", "parse_success", "tested", "all_tests_passed")
    return one.select(F.expr(f"stack({len(names)}, {', '.join(f"'{k}', {i}, {k}_count, {k}_weighted_count" for i, k in enumerate(names))}) AS (step, step_index, row_count, weighted_count)")).orderBy("step_index")


def task_hardness(rows: DataFrame) -> DataFrame:
    return slice_by(rows, F.col("task_id")).select(F.col("slice_key").alias("task_id"), "tested_count", "pass_count", "pass_rate").orderBy(F.asc_nulls_last("pass_rate"), "task_id")


def joint_objective(rows: DataFrame, factor: float = JOINT_LAMBDA) -> DataFrame:
    return rows.where(tested()).select("sample_id", "pos", (passed().cast("int") - F.lit(factor) * F.col("decoder_input_len_zstd22")).alias("objective"))


def outcome_table(rows: DataFrame) -> DataFrame:
    """Attempts, weights and passes of each outcome kind, null where there was no test."""
    weight = F.coalesce(F.col(WEIGHT), F.lit(0))
    return rows.groupBy("outcome_kind").agg(
        F.count("*").alias("row_count"), F.sum(weight).cast("long").alias("weighted_count"), F.count_if(passed()).alias("passed"), F.count_distinct("sample_id").alias("samples")
    )
