"""Row constructors and scalar functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the prompt that a decoder gets.
DECODER_TEMPLATE = ('Write functional code in Python according to the description.\n\n"""\n', '\n"""\n')
#: Pool columns and the parts of the provenance that they become.
POOL_MAPPING = {"model": "model", "pool_name": "pool_name", "prompt_template_id": "prompt_template_id", "enc_llm_config_id": "enc_llm_config_id", "dec_llm_config_id": "dec_llm_config_id", "attempt_id": "pool_attempt_id"}
POOL_TEXT = ("human_eval_task_id", "decoder_input_description", "raw_code_output")
UNKNOWN = "(unknown)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sample_id(task_id: Column | str, raw_output: Column | str) -> Column:
    """The first 16 hex digits of SHA-256 over task, NUL and output."""
    return F.substring(F.sha2(F.concat(_c(task_id), F.char(F.lit(0)), _c(raw_output)), 256), 1, 16)


def or_unknown(c: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(UNKNOWN))


def truncated(c: Column | str, size: int) -> Column:
    return F.when(F.length(_c(c)) <= size, _c(c)).otherwise(F.concat(F.substring(_c(c), 1, size - 3), F.lit("...")))


def indented(c: Column | str, spaces: int) -> Column:
    return F.array_join(F.transform(F.split(_c(c), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.concat(F.lit(" " * spaces), x)), "\n")


def decoder_prompt(prompt: Column | str) -> Column:
    return F.concat(F.lit(DECODER_TEMPLATE[0]), _c(prompt), F.lit(DECODER_TEMPLATE[1]))


def full_source(prompt: Column | str = "prompt", solution: Column | str = "canonical_solution") -> Column:
    return F.concat(_c(prompt), _c(solution))


def dedup_task_id(file_name: Column | str) -> Column:
    """The task of a dedup file, by its name; null for other names."""
    n = F.regexp_extract(_c(file_name), r"human_eval-(\d+)-decode-dedup\.jsonl$", 1)
    return F.when(n != "", F.concat(F.lit("HumanEval/"), n))


def pass_label(passed: Column | str) -> Column:
    return F.when(_c(passed).isNull(), "not_tested").when(_c(passed), "pass").otherwise("fail")


def parsed_list(text: Column | str) -> Column:
    """The non-blank parts between commas."""
    return F.filter(F.transform(F.split(_c(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def numbers_close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return (a == b) | (F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)))


def canonical_json(mapping: Column | str) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_c(mapping)))))


def provenance(source: Column | str, occurrence_count: Column | int = 1, extra: Column | None = None, **parts: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        *(parts.get(k, none).cast("string").alias(k) for k in ("model", "pool_name", "prompt_template_id", "enc_llm_config_id", "dec_llm_config_id")),
        (F.lit(occurrence_count) if isinstance(occurrence_count, int) else occurrence_count).cast("long").alias("occurrence_count"),
        parts.get("pool_attempt_id", none).cast("string").alias("pool_attempt_id"),
        (F.create_map().cast("map<string,string>") if extra is None else extra).alias("extra"),
    )


def residual(pool: DataFrame) -> Column:
    """All pool columns that have no place of their own, as a map; nulls are left out."""
    rest = [c for c in pool.columns if c not in POOL_MAPPING and c not in POOL_TEXT and not c.startswith("__")]
    if not rest:
        return F.create_map().cast("map<string,string>")
    every = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*(F.col(c).cast("string") for c in rest)))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def attempt(task_id, entry_point, decoder_input, raw_output, provenance_: Column, run_id: Column | None = None) -> list[Column]:
    """The columns of a new attempt."""
    return [
        sample_id(task_id, raw_output).alias("sample_id"),
        (F.lit(None) if run_id is None else run_id).cast("string").alias("run_id"),
        _c(task_id).alias("task_id"),
        _c(entry_point).alias("entry_point"),
        _c(decoder_input).alias("decoder_input"),
        _c(raw_output).alias("raw_output"),
        provenance_.alias("provenance"),
    ]


def from_pool(pool: DataFrame, entry_point: Column | str = "entry_point", keep: tuple[str, ...] = ()) -> DataFrame:
    parts = {to: F.col(c) for c, to in POOL_MAPPING.items() if c in pool.columns}
    extra = residual(pool.drop("entry_point", *keep))
    return pool.select(*attempt(*("human_eval_task_id", entry_point, "decoder_input_description", "raw_code_output"), provenance("pool", extra=extra, **parts)), *keep)


def fresh_stub(tasks: DataFrame, decoder_input: Column, raw_output: Column, run_id: Column, model: Column, profile_id: Column) -> DataFrame:
    made = provenance("fresh_stub", extra=F.create_map(F.lit("profile_id"), profile_id), model=model)
    return tasks.select(*attempt("task_id", "entry_point", decoder_input, raw_output, made, run_id))


def from_bottleneck(rows: DataFrame, encode_model: str | None = None, extra: Column | None = None, **parts: Column) -> DataFrame:
    """rows: task_id, entry_point, decoder_input, raw_output. A null encode_model isn't noted."""
    base = F.create_map().cast("map<string,string>") if extra is None else extra
    if encode_model:
        more = F.when(F.col(encode_model).isNotNull(), F.create_map(F.lit("encode_model"), F.col(encode_model))).otherwise(F.create_map().cast("map<string,string>"))
        base = F.map_concat(F.map_filter(base, lambda k, _: k != "encode_model"), more)
    return rows.select(*attempt("task_id", "entry_point", "decoder_input", "raw_output", provenance("bottleneck", extra=base, **parts)))


def flattened(attempts: DataFrame) -> DataFrame:
    from ..schemas import PROVENANCE_COLUMNS

    plain = [F.col(c) for c in attempts.columns if c != "provenance"]
    return attempts.select(*plain, *(F.col(f"provenance.{c}").alias(f"provenance_{c}") for c in PROVENANCE_COLUMNS), canonical_json("provenance.extra").alias("provenance_extra_json"))


def nested(flat: DataFrame) -> DataFrame:
    """Flat rows as attempts: a missing count is 1, a missing or odd extra is empty, other parts may be absent."""
    from ..schemas import FLAT_REQUIRED

    have = set(flat.columns)
    part = lambda c: F.col(f"provenance_{c}").cast("string") if f"provenance_{c}" in have else F.lit(None).cast("string")
    count = F.coalesce(F.expr("try_cast(try_cast(provenance_occurrence_count as double) as bigint)"), F.lit(1)) if "provenance_occurrence_count" in have else F.lit(1)
    empty = F.create_map().cast("map<string,string>")
    extra = F.coalesce(F.from_json("provenance_extra_json", "map<string,string>"), empty) if "provenance_extra_json" in have else empty
    made = provenance(part("source"), count, extra, **{c: part(c) for c in ("model", "pool_name", "prompt_template_id", "enc_llm_config_id", "dec_llm_config_id", "pool_attempt_id")})
    run = F.col("run_id").cast("string") if "run_id" in have else F.lit(None).cast("string")
    required = {c: F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in FLAT_REQUIRED}
    rest = [c for c in flat.columns if not c.startswith("provenance_") and c not in required and c != "run_id"]
    return flat.select(required["sample_id"], run.alias("run_id"), *(required[c] for c in FLAT_REQUIRED[1:]), made.alias("provenance"), *rest)


def stamped(attempts: DataFrame, run_id: str) -> DataFrame:
    return attempts.withColumn("run_id", F.lit(run_id))


def envelopes(attempts: DataFrame, run_id: Column, pipeline_id: str, position: Column) -> DataFrame:
    """Jobs: each attempt as payload, repeat the position from 0."""
    return attempts.select(run_id.alias("run_id"), F.lit("default").alias("lane"), position.cast("long").alias("repeat"), F.lit(0).alias("step_index"), F.lit(pipeline_id).alias("pipeline_id"), F.to_json(F.struct(F.struct(*(c for c in attempts.columns if c != "__at")).alias("attempt")), {"ignoreNullFields": "false"}).alias("payload"))


def opened(jobs: DataFrame, schema: str) -> DataFrame:
    """The attempts in jobs; a job without one is an error."""
    from ..schemas import required

    text = F.get_json_object("payload", "$.attempt")
    return jobs.select("repeat", F.from_json(required(text, text.isNull(), "job payload has no attempt"), schema).alias("a")).select("repeat", "a.*")


def step_label(extractor: Column, produced: Column, valid: Column, notes: Column) -> Column:
    """How a step of an extraction log is summarised."""
    head = F.concat(extractor, F.lit(":produced="), produced.cast("string"), F.lit(":valid="), F.initcap(valid.cast("string")))
    return F.when(F.coalesce(notes, F.lit("")) == "", head).otherwise(F.concat(head, F.lit(":"), notes))


def parse_step_output() -> Column:
    """What a parse stage tells the next one."""
    return F.struct("parse_success", "sample_id", "task_id")


def test_step_output() -> Column:
    return F.struct("outcome_kind", "sample_id", "task_id", "all_tests_passed")


test_step_output.__test__ = False


def eval_code(code: Column | str, entry_point: Column | str) -> Column:
    """Code with a function that runs one case. Fixed value: the function's name and text."""
    head = F.regexp_replace(_c(code), r"\s+$", "")
    return F.concat(head, F.lit("\n\n\ndef run_single_test_case(input_value):\n    return "), _c(entry_point), F.lit("(*input_value)\n"))


def seed_source(attempts: Column | str, attempts_path: Column | str, dump_dir: Column | str) -> Column:
    """Which of its sources a run was seeded from; exactly one is given."""
    given = [F.when(_c(c).isNotNull(), F.lit(k)) for c, k in ((attempts, "in_memory"), (attempts_path, "attempts_path"), (dump_dir, "dump_dir"))]
    many = sum((g.isNotNull().cast("int") for g in given[1:]), given[0].isNotNull().cast("int"))
    return F.when(many != 1, F.raise_error(F.lit("give exactly one seed source")).cast("string")).otherwise(F.coalesce(*given))


#: Texts that stand for an outcome's kind.
def outcome_banner() -> Column:
    """One line for a row of test outcomes."""
    cases = F.col("test_case_results")
    hit, all_ = F.size(F.filter(cases, lambda c: F.coalesce(c["passed"], F.lit(False)))), F.size(cases)
    kind = F.col("outcome_kind")
    return (
        F.when(kind == "skipped", F.concat(F.lit("[SKIPPED: "), F.coalesce(F.nullif(F.col("skip_reason"), F.lit("")), F.lit("skipped")), F.lit("]")))
        .when(kind == "infra_error", F.concat(F.lit("[INFRA ERROR: "), F.coalesce(F.col("infra_error.stage"), F.lit("unknown")), F.lit("]")))
        .when(kind == "internal_error", F.concat(F.lit("[INTERNAL ERROR: "), F.split(F.coalesce(F.nullif(F.col("internal_error"), F.lit("")), F.lit("unknown")), "[\r\n]")[0], F.lit("]")))
        .when(F.coalesce(F.col("all_tests_passed"), F.lit(False)), F.lit("[ALL TESTS PASSED]"))
        .otherwise(F.concat(F.lit("[TEST FAIL: "), F.greatest(hit, F.lit(0)).cast("string"), F.lit("/"), F.greatest(all_, F.lit(0)).cast("string"), F.lit(" passed]")))
    )


def record_preview(size: int = 120) -> list[Column]:
    return [F.col("sample_id"), F.col("task_id"), truncated("decoder_input", size).alias("decoder_input_preview"), truncated("raw_output", size).alias("raw_output_preview")]


def walkthrough(size: int = 600) -> Column:
    """A text block for an attempt with its parse and test outcome."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c.cast("string"), F.lit("-")))
    block = lambda name, c: F.concat(F.lit(f"{name}:\n"), indented(truncated(F.coalesce(c, F.lit("")), size), 2))
    return F.concat_ws("\n", line("sample", F.col("sample_id")), line("task", F.col("task_id")), block("raw output", F.col("raw_output")), line("parsed", F.col("parse_success")), block("code", F.col("extracted_code")), line("outcome", F.col("outcome_kind")))
