"""Schemas of the tables, and the checks that a closed schema needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROVENANCE = "source STRING, model STRING, pool_name STRING, prompt_template_id STRING, enc_llm_config_id STRING, dec_llm_config_id STRING, occurrence_count BIGINT, pool_attempt_id STRING, extra MAP<STRING, STRING>"
ATTEMPTS = f"sample_id STRING, run_id STRING, task_id STRING, entry_point STRING, decoder_input STRING, raw_output STRING, provenance STRUCT<{', '.join(c.replace(' ', ': ', 1) for c in PROVENANCE.replace('MAP<STRING, STRING>', 'MAP<STRING# STRING>').split(', '))}>".replace("#", ",")
#: Scalar parts of the provenance, in the order of flat files.
PROVENANCE_COLUMNS = ("source", "model", "pool_name", "prompt_template_id", "enc_llm_config_id", "dec_llm_config_id", "occurrence_count", "pool_attempt_id")
FLAT_REQUIRED = ("sample_id", "task_id", "entry_point", "decoder_input", "raw_output")
TASKS = "task_id STRING, entry_point STRING, prompt STRING, canonical_solution STRING, test STRING"
DEDUP = "out STRING, count BIGINT"
CODE_EVAL = "config_fingerprint STRING, selected_candidate_id STRING, selected_attempt_id STRING, recovery_attempt_count INT, extractor_path ARRAY<STRING>, repairs_applied ARRAY<STRING>, extraction_log_summary ARRAY<STRING>"
PARSE_OUTCOMES = f"sample_id STRING, run_id STRING, task_id STRING, parse_success BOOLEAN, extracted_code STRING, candidate_count INT, valid_count INT, code_eval STRUCT<{', '.join(c.replace(' ', ': ', 1) for c in CODE_EVAL.split(', '))}>, skip_reason STRING, latency_ms DOUBLE"
CASE_RESULT = "input_value: STRING, expected_output: STRING, actual_output: STRING, passed: BOOLEAN, error: STRING, compile_success: BOOLEAN, compile_error: STRING"
TEST_OUTCOMES = f"sample_id STRING, run_id STRING, task_id STRING, parse_success BOOLEAN, outcome_kind STRING, skipped BOOLEAN, skip_reason STRING, tests_ran BOOLEAN, entry_point STRING, extracted_code STRING, test_pass_rate DOUBLE, all_tests_passed BOOLEAN, test_case_results ARRAY<STRUCT<{CASE_RESULT}>>, infra_error STRUCT<stage: STRING, execution_mode: STRING, detail: STRING>, internal_error STRING, latency_ms DOUBLE"
EVENTS = "run_id STRING, job_id STRING, lane STRING, stage STRING, event STRING, timestamp STRING, payload STRING"
METADATA = "run_id STRING, init STRING, seed STRING"

#: Fixed values of enumerated columns.
SOURCES = ("bottleneck", "pool", "fresh_stub")
OUTCOME_KINDS = ("skipped", "tested", "infra_error", "internal_error")
SEED_SOURCES = ("attempts_path", "dump_dir", "in_memory")


def required(value: Column, wrong: Column, message: Column | str) -> Column:
    """value, or an error where wrong holds (for rows that are evaluated)."""
    return F.when(wrong, F.raise_error(F.lit(message) if isinstance(message, str) else message).cast("string")).otherwise(value)


def _empty(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0)) == 0


def _unknown(c: Column, values: tuple[str, ...]) -> Column:
    return ~F.coalesce(c.isin(*values), F.lit(False))


def non_empty(name: str) -> Column:
    c = F.col(name)
    return required(c, _empty(c), f"{name} must be non-empty").alias(name)


def one_of(name: str, values: tuple[str, ...]) -> Column:
    c = F.col(name)
    return required(c, _unknown(c, values), F.concat(F.lit(f"{name} is not one of {', '.join(values)}: "), F.coalesce(c, F.lit("null")))).alias(name)


def refused(non_empty: tuple[str, ...] = (), one_of: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The columns by which these checks refuse a row, none if they accept it: to tell such rows apart where one of them must not end a job over all."""
    wrong = [(n, _empty(F.col(n))) for n in non_empty] + [(n, _unknown(F.col(n), values)) for n, values in (one_of or {}).items()]
    return F.array_compact(F.array(*(F.when(w, F.lit(n)) for n, w in wrong)))


def only_keys(line: str, allowed: list[str]) -> Column:
    """A JSON text column, or an error where its object has a key that the schema lacks."""
    odd = F.array_except(F.json_object_keys(line), F.array(*map(F.lit, allowed)))
    return required(F.col(line), F.coalesce(F.size(odd), F.lit(0)) > 0, F.concat(F.lit("unknown keys: "), F.array_join(odd, ", "))).alias(line)


def checked_outcomes(test: DataFrame) -> DataFrame:
    """Test outcomes, or an error where a row contradicts its kind: results come with tested rows only, and an error's text with its kind."""
    kind, cases = F.col("outcome_kind"), F.coalesce(F.size("test_case_results"), F.lit(0))
    tested = kind == "tested"
    wrong = (
        (tested & (F.col("test_pass_rate").isNull() | (cases <= 0) | F.col("infra_error").isNotNull() | F.col("internal_error").isNotNull()))
        | (~tested & (F.col("test_pass_rate").isNotNull() | (cases > 0)))
        | ((kind == "infra_error") & F.col("infra_error").isNull())
        | ((kind == "internal_error") & F.col("internal_error").isNull())
    )
    bad = F.coalesce(wrong, F.lit(True)) | ~F.coalesce(kind.isin(*OUTCOME_KINDS), F.lit(False))
    return test.withColumn("outcome_kind", required(kind, bad, F.concat(F.lit("contradictory outcome of sample "), F.coalesce("sample_id", F.lit("null")))))


def cast_to(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of a schema, cast; those that a file lacks (or stores as void) are null."""
    from pyspark.sql.types import StructType

    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl)))
