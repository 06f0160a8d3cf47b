"""The query catalog: every operator over the bound tables, with the SQL that an independent engine runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cases as K
from ..operators import events as E
from ..operators import outcomes as O
from ..operators import slices as S
from ..operators import stats as T
from . import bindings as B
from .bindings import _TASK, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return keep


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched rows whose compressed length is the byte length, which SQL can compute too."""
    rows = O.enriched(B.attempts(spark, sf_dir), B.parse_outcomes(spark, sf_dir), B.test_outcomes(spark, sf_dir), zstd=F.octet_length("decoder_input").cast("long"))
    return rows


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.attempts(spark, sf_dir).select(F.octet_length("decoder_input").cast("long").alias("decoder_input_len_zstd22"))


def quartiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with quartiles; the cut points need the attempts only."""
    return O.with_quartile(enriched(spark, sf_dir), sizes=sizes(spark, sf_dir))


MEASURES = """count(*) AS row_count, CAST(sum(provenance_occurrence_count) AS BIGINT) AS weighted_count, CAST(count_if(is_tested) AS BIGINT) AS tested_count,
CAST(coalesce(sum(provenance_occurrence_count) FILTER (is_tested), 0) AS BIGINT) AS tested_weighted_count, CAST(count_if(is_passed) AS BIGINT) AS pass_count,
CAST(coalesce(sum(provenance_occurrence_count) FILTER (is_passed), 0) AS BIGINT) AS weighted_pass_count,
CAST(count_if(is_passed) AS DOUBLE) / nullif(count_if(is_tested), 0) AS pass_rate,
CAST(coalesce(sum(provenance_occurrence_count) FILTER (is_passed), 0) AS DOUBLE) / nullif(sum(provenance_occurrence_count) FILTER (is_tested), 0) AS weighted_pass_rate"""
_MODEL = "coalesce(nullif(provenance_model, ''), '(unknown)')"


def _slice_sql(key: str) -> str:
    return sql(f"SELECT {key} AS slice_key, {MEASURES} FROM enriched GROUP BY 1", "enriched")


@query(_slice_sql("provenance_source"))
def slice_by_source(spark, sf_dir):
    return S.slice_by(enriched(spark, sf_dir), F.col("provenance_source"))


@query(_slice_sql(_MODEL))
def slice_by_model(spark, sf_dir):
    return S.slice_by(enriched(spark, sf_dir), C.or_unknown("provenance_model"))


@query(_slice_sql("task_id"))
def slice_by_task(spark, sf_dir):
    return S.slice_by(enriched(spark, sf_dir), F.col("task_id"))


@query(_slice_sql("coalesce(compression_quartile, '(unknown)')"))
def slice_by_quartile(spark, sf_dir):
    return S.slice_by(quartiled(spark, sf_dir), F.coalesce("compression_quartile", F.lit(C.UNKNOWN)))


@query(sql(" UNION ALL ".join(f"SELECT '{n}' AS slice_name, {k} AS slice_key, {MEASURES} FROM enriched GROUP BY 2" for n, k in (("by_source", "provenance_source"), ("by_model", _MODEL), ("by_task", "task_id"), ("by_compression_quartile", "compression_quartile"))), "enriched"))
def slices_all(spark, sf_dir):
    return S.all_slices(quartiled(spark, sf_dir))


_ROW = "pos, sample_id, run_id, task_id, entry_point, decoder_input_len_raw, provenance_source, provenance_model, provenance_occurrence_count, parse_success, parse_skip_reason, has_test_outcome, outcome_kind, tests_ran, all_tests_passed, test_pass_rate, skipped, skip_reason, compression_quartile"


@query(sql(f"SELECT {_ROW} FROM enriched", "enriched"))
def enriched_rows(spark, sf_dir):
    return quartiled(spark, sf_dir).select(*_ROW.split(", "))


@query(sql("""SELECT count(*) AS attempt_count, CAST(count_if(is_passed) AS BIGINT) AS tested_pass_count, CAST(count_if(is_tested AND NOT is_passed) AS BIGINT) AS tested_fail_count,
CAST(count_if(is_passed) AS DOUBLE) / nullif(count_if(is_tested), 0) AS correctness_pass_rate,
CAST(sum(provenance_occurrence_count) FILTER (is_passed) AS DOUBLE) / nullif(sum(provenance_occurrence_count) FILTER (is_tested), 0) AS correctness_pass_rate_weighted FROM enriched""", "enriched"))
def run_summary(spark, sf_dir):
    return S.summary(enriched(spark, sf_dir))


@query(sql("SELECT outcome_kind, count(*) AS row_count, CAST(sum(provenance_occurrence_count) AS BIGINT) AS weighted_count FROM enriched WHERE has_test_outcome GROUP BY 1", "enriched"))
def outcome_kind_counts(spark, sf_dir):
    return S.outcome_kinds(enriched(spark, sf_dir))


_STEPS = (("raw", "true"), ("parse_success", "coalesce(parse_success, false)"), ("tested", "is_tested"), ("all_tests_passed", "is_passed"))


@query(sql("SELECT " + ", ".join(f"CAST(count_if({c}) AS BIGINT) AS {k}_count, CAST(coalesce(sum(provenance_occurrence_count) FILTER ({c}), 0) AS BIGINT) AS {k}_weighted_count" for k, c in _STEPS) + " FROM enriched", "enriched"))
def parse_funnel(spark, sf_dir):
    return S.funnel(enriched(spark, sf_dir))


@query(sql(" UNION ALL ".join(f"SELECT '{k}' AS step, {i} AS step_index, CAST(count_if({c}) AS BIGINT) AS row_count, CAST(coalesce(sum(provenance_occurrence_count) FILTER ({c}), 0) AS BIGINT) AS weighted_count FROM enriched" for i, (k, c) in enumerate(_STEPS)), "enriched"))
def funnel_steps(spark, sf_dir):
    return S.funnel_steps(enriched(spark, sf_dir))


@query(sql("SELECT count(*) AS attempt_count, CAST(count_if(has_parse_outcome) AS BIGINT) AS matched_parse, CAST(count_if(has_test_outcome) AS BIGINT) AS matched_test FROM enriched", "enriched"))
def join_coverage(spark, sf_dir):
    return O.coverage(enriched(spark, sf_dir))


@query(sql("SELECT pos, sample_id FROM enriched WHERE NOT has_parse_outcome", "enriched"))
def missing_parse_ids(spark, sf_dir):
    return O.missing(enriched(spark, sf_dir), "parse")


@query(sql("SELECT pos, sample_id FROM enriched WHERE NOT has_test_outcome", "enriched"))
def missing_test_ids(spark, sf_dir):
    return O.missing(enriched(spark, sf_dir), "test")


@query(sql("SELECT DISTINCT sample_id FROM attempts WHERE sample_id NOT IN (SELECT sample_id FROM test)", "attempts", "test"))
def untested_ids(spark, sf_dir):
    return O.untested_ids(B.attempts(spark, sf_dir), B.test_outcomes(spark, sf_dir))


@query(sql("SELECT sample_id, pos, task_id, run_id, outcome_kind, all_tests_passed FROM lt", "last"))
def latest_outcome(spark, sf_dir):
    return O.latest(B.test_outcomes(spark, sf_dir), "sample_id").select("sample_id", "pos", "task_id", "run_id", "outcome_kind", "all_tests_passed")


@query(sql("SELECT run_id, sample_id, pos, outcome_kind FROM (SELECT *, row_number() OVER (PARTITION BY run_id, sample_id ORDER BY pos DESC) AS rn FROM test) WHERE rn = 1", "test"))
def upserted_results(spark, sf_dir):
    return O.latest(B.test_outcomes(spark, sf_dir), "run_id", "sample_id", null_keys=True).select("run_id", "sample_id", "pos", "outcome_kind")


@query(sql("SELECT run_id, outcome_kind, count(*) AS row_count FROM test GROUP BY 1, 2", "test"))
def results_per_run(spark, sf_dir):
    return B.test_outcomes(spark, sf_dir).groupBy("run_id", "outcome_kind").agg(F.count("*").alias("row_count"))


@query(sql("SELECT pos, sample_id, task_id FROM attempts", "attempts"))
def sample_ids(spark, sf_dir):
    return B.attempts(spark, sf_dir).select("pos", "sample_id", "task_id")


def _percentile_sql(c: str) -> str:
    v = f"(SELECT list_sort(list(length({c}))) AS v, count(*) AS n FROM attempts)"
    return f"(SELECT CAST(floor((v[CAST(floor((n - 1) / 2.0) AS BIGINT) + 1] + v[CAST(floor(n / 2.0) AS BIGINT) + 1]) / 2.0) AS BIGINT) FROM {v}) AS {c}_length_p50, (SELECT v[CAST(round_even(0.9 * (n - 1), 0) AS BIGINT) + 1] FROM {v}) AS {c}_length_p90"


@query(sql(f"SELECT count(*) AS record_count, CAST(sum(provenance_occurrence_count) AS BIGINT) AS weighted_count, count(DISTINCT task_id) AS unique_tasks, {_percentile_sql('decoder_input')}, {_percentile_sql('raw_output')} FROM attempts", "attempts"))
def attempt_stats(spark, sf_dir):
    return T.attempt_stats(B.attempts(spark, sf_dir))


@query(sql("SELECT task_id, count(*) AS row_count, min(pos) AS first_pos FROM attempts GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 5", "attempts"))
def top_tasks(spark, sf_dir):
    return T.top_tasks(B.attempts(spark, sf_dir))


@query(sql("SELECT provenance_source AS source, count(*) AS row_count FROM attempts GROUP BY 1", "attempts"))
def source_breakdown(spark, sf_dir):
    return T.source_breakdown(B.attempts(spark, sf_dir))


@query(sql("SELECT pos, sample_id, task_id, CASE WHEN length(decoder_input) <= 120 THEN decoder_input ELSE substr(decoder_input, 1, 117) || '...' END AS decoder_input_preview, CASE WHEN length(raw_output) <= 120 THEN raw_output ELSE substr(raw_output, 1, 117) || '...' END AS raw_output_preview FROM attempts ORDER BY pos LIMIT 3", "attempts"))
def sample_previews(spark, sf_dir):
    return T.first_samples(B.attempts(spark, sf_dir))


@query(sql("SELECT task_id, arg_min(CASE WHEN provenance_source = 'pool' THEN sample_id END, CASE WHEN provenance_source = 'pool' THEN pos END) AS pool_sample_id, arg_min(CASE WHEN provenance_source = 'fresh_stub' THEN sample_id END, CASE WHEN provenance_source = 'fresh_stub' THEN pos END) AS fresh_sample_id FROM attempts GROUP BY 1", "attempts"))
def spot_check(spark, sf_dir):
    return T.spot_check(B.attempts(spark, sf_dir))


@query(sql("SELECT pos, sample_id FROM attempts WHERE task_id = 'HumanEval/3' ORDER BY pos LIMIT 1 OFFSET 2", "attempts"))
def nth_of_task(spark, sf_dir):
    return T.nth_of_task(B.attempts(spark, sf_dir), "HumanEval/3", 2).select("pos", "sample_id")


@query(sql("SELECT task_id, raw_output, count(*) AS count FROM attempts GROUP BY 1, 2", "attempts"))
def pool_dedup(spark, sf_dir):
    return T.dedup_pool(B.attempts(spark, sf_dir), "task_id")


_MATCH = """pool AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN text || ' (other)' ELSE text END AS raw, source, 'describe ' || CAST(doc_id AS VARCHAR) AS description FROM documents),
dd AS (SELECT text AS out, count(*) AS count FROM documents GROUP BY 1), f AS (SELECT raw, arg_min(source, doc_id) AS pool_name, arg_min(description, doc_id) AS description FROM pool GROUP BY 1)"""


@query(f"WITH {_MATCH} SELECT sha256(out) AS out_sha256, count, raw IS NOT NULL AS matched, pool_name, coalesce(description, 'prompt') AS decoder_input FROM dd LEFT JOIN f ON out = raw")
def dedup_first_match(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents")
    pool = docs.select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" (other)"))).otherwise(F.col("text")).alias("raw_code_output"), F.col("source").alias("pool_name"), F.concat(F.lit("describe "), F.col("doc_id").cast("string")).alias("decoder_input_description"))
    dedup = docs.groupBy(F.col("text").alias("out")).agg(F.count("*").alias("count"))
    return T.with_first_match(dedup, pool, F.lit("prompt")).select(F.sha2("out", 256).alias("out_sha256"), "count", "matched", "pool_name", "decoder_input")


@query(sql("SELECT task_id, count(*) AS row_count FROM attempts WHERE task_id NOT IN (SELECT task_id FROM tasks) GROUP BY 1", "attempts", "tasks"))
def unknown_tasks(spark, sf_dir):
    return T.unknown_tasks(B.attempts(spark, sf_dir), B.tasks(spark, sf_dir))


def known_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks, and one for the attempts that have none."""
    t = B.tasks(spark, sf_dir).select("task_id", "entry_point", "prompt")
    return t.unionByName(spark.range(1).select(F.lit("HumanEval/40").alias("task_id"), F.lit("task_fn_40").alias("entry_point"), F.lit("no item").alias("prompt")))


KNOWN = "known AS (SELECT task_id, entry_point, prompt FROM tasks UNION ALL SELECT 'HumanEval/40', 'task_fn_40', 'no item')"


def known_sql(body: str, *names: str) -> str:
    return sql("", *names, "tasks").rstrip() + f", {KNOWN} {body}"


@query(known_sql("SELECT a.pos, a.task_id, t.entry_point FROM attempts a JOIN known t ON a.task_id = t.task_id", "attempts"))
def strict_task_join(spark, sf_dir):
    return T.strict_tasks(B.attempts(spark, sf_dir).drop("entry_point"), known_tasks(spark, sf_dir)).select("pos", "task_id", "entry_point")


@query(sql("SELECT job_id, stage, latency_us FROM timing", "timing"))
def stage_timing(spark, sf_dir):
    return E.stage_timing(B.events(spark, sf_dir))


_RATES = "count(*) AS outputs, CAST(sum(latency_us) AS BIGINT) AS total_us, CASE WHEN sum(latency_us) > 0 THEN CAST(count(*) AS DOUBLE) / (CAST(CAST(sum(latency_us) AS BIGINT) AS DOUBLE) / 1e6) ELSE 0.0 END AS samples_per_second"


@query(sql(f"SELECT stage, {_RATES} FROM timing GROUP BY 1", "timing"))
def stage_throughput(spark, sf_dir):
    e = B.events(spark, sf_dir)
    return E.throughput(E.stage_timing(e), E.job_tasks(e)).where("task_id IS NULL").drop("task_id")


@query(sql(f"SELECT coalesce(task_id, 'unknown') AS task_id, stage, {_RATES} FROM timing LEFT JOIN jobtasks USING (job_id) GROUP BY 1, 2", "timing", "jobtasks"))
def task_stage_throughput(spark, sf_dir):
    e = B.events(spark, sf_dir)
    return E.throughput(E.stage_timing(e), E.job_tasks(e)).where("task_id IS NOT NULL")


@query(sql("SELECT count_if(event = 'terminal') AS terminal_count, coalesce(max(us) FILTER (event = 'terminal') - min(us) FILTER (event = 'stage_started'), 0) AS wall_us FROM log", "log").replace("count_if(event = 'terminal') AS", "CAST(count_if(event = 'terminal') AS BIGINT) AS"))
def wall_seconds(spark, sf_dir):
    return E.wall(B.events(spark, sf_dir))


@query(sql("SELECT job_id, task_id FROM jobtasks", "jobtasks"))
def job_tasks(spark, sf_dir):
    return E.job_tasks(B.events(spark, sf_dir))


@query(sql("SELECT stage, CAST(count_if(event = 'stage_started') AS BIGINT) AS started, CAST(count_if(event = 'stage_output') AS BIGINT) AS completed, CAST(count_if(event = 'terminal') AS BIGINT) AS terminals, count(DISTINCT job_id) AS jobs FROM log WHERE run_id = 'run-1' GROUP BY 1", "log"))
def run_status(spark, sf_dir):
    return E.status(E.of_run(B.events(spark, sf_dir), "run-1"))


@query(sql("SELECT CAST(count_if(event = 'stage_output' AND stage = 'parse') AS BIGINT) AS completions FROM log", "log"))
def stage_completions(spark, sf_dir):
    return E.stage_completions(B.events(spark, sf_dir), "parse")


@query(sql("""SELECT task_id, count(*) AS seeded, CAST(count_if(coalesce(ps, false)) AS BIGINT) AS parse_success, CAST(count_if(coalesce(tk = 'tested', false)) AS BIGINT) AS tested,
CAST(count_if(coalesce(tk = 'tested' AND tp, false)) AS BIGINT) AS all_tests_passed FROM e0 GROUP BY 1""", "enriched"))
def proof_outcomes_by_task(spark, sf_dir):
    return E.proof_outcomes(B.attempts(spark, sf_dir), B.parse_outcomes(spark, sf_dir), B.test_outcomes(spark, sf_dir))


@query(sql("SELECT tk AS outcome_kind, count(*) AS row_count, CAST(sum(provenance_occurrence_count) AS BIGINT) AS weighted_count FROM e0 WHERE tk IS NOT NULL GROUP BY 1", "enriched"))
def proof_outcome_kinds(spark, sf_dir):
    return E.proof_kinds(B.attempts(spark, sf_dir), B.test_outcomes(spark, sf_dir))


_SAID = "CASE l_orderkey % 6 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(B.MESSAGES)) + " END"
_CASES = f"SELECT l_orderkey, l_returnflag = 'A' AS passed, CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linestatus = 'F' THEN {_SAID} ELSE 'other' END AS error FROM lineitem"


@query(f"SELECT l_orderkey, count(*) AS case_count, CAST(count_if(passed) AS DOUBLE) / count(*) AS test_pass_rate FROM ({_CASES}) GROUP BY 1")
def case_pass_rate(spark, sf_dir):
    return B.cases(spark, sf_dir).select("l_orderkey", F.size("test_case_results").cast("long").alias("case_count"), K.pass_rate(F.col("test_case_results")).alias("test_pass_rate"))


@query(f"SELECT l_orderkey, CASE WHEN NOT bool_or(passed) AND count(error) = count(*) AND count(DISTINCT error) = 1 AND min(error) <> 'other' AND min(error) <> 'ValueError: worker' THEN 'infra_error' ELSE 'tested' END AS outcome_kind FROM ({_CASES}) GROUP BY 1")
def infra_reclassify(spark, sf_dir):
    return B.cases(spark, sf_dir).select("l_orderkey", K.reclassified(F.col("test_case_results")).alias("outcome_kind"))


@query(f"""SELECT l_orderkey, CASE l_orderkey % 5 WHEN 0 THEN '[SKIPPED: skipped]' WHEN 1 THEN '[INFRA ERROR: worker_timeout]' WHEN 2 THEN '[INTERNAL ERROR: line one]'
ELSE CASE WHEN bool_and(passed) THEN '[ALL TESTS PASSED]' ELSE '[TEST FAIL: ' || CAST(count_if(passed) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) || ' passed]' END END AS banner FROM ({_CASES}) GROUP BY 1""")
def outcome_banner(spark, sf_dir):
    k = F.col("l_orderkey") % 5
    rows = B.cases(spark, sf_dir).select(
        "*", F.when(k == 0, "skipped").when(k == 1, "infra_error").when(k == 2, "internal_error").otherwise("tested").alias("outcome_kind"), F.lit("").alias("skip_reason"),
        F.struct(F.lit("worker_timeout").alias("stage")).alias("infra_error"), F.lit("line one\nline two").alias("internal_error"), F.forall("test_case_results", lambda c: c["passed"]).alias("all_tests_passed"),
    )
    return rows.select("l_orderkey", C.outcome_banner().alias("banner"))


_ROUTE = """CASE WHEN p.sample_id IS NULL THEN 'missing_parse_outcome' WHEN NOT p.parse_success OR p.extracted_code IS NULL THEN NULL
WHEN t.task_id IS NULL THEN 'unknown task: ' || a.task_id ELSE t.problem END"""


@query(sql(f"""SELECT pos, sample_id, run_id, internal_error, CASE WHEN internal_error IS NOT NULL THEN 'internal_error' WHEN skip_reason IS NOT NULL THEN 'skipped' ELSE 'execute' END AS route, skip_reason,
CASE WHEN internal_error IS NULL AND skip_reason IS NULL THEN entry_point WHEN skip_reason = 'unsupported_test_shape' THEN task_entry_point END AS entry_point FROM (
SELECT *, CASE WHEN internal_error IS NOT NULL THEN NULL WHEN NOT parse_success THEN coalesce(nullif(sr, ''), 'parse_failed') WHEN extracted_code IS NULL THEN 'parse_failed' WHEN shape <> 'inputs_results' THEN 'unsupported_test_shape' END AS skip_reason FROM (
SELECT a.pos, a.sample_id, coalesce(nullif(p.run_id, ''), a.run_id) AS run_id, {_ROUTE} AS internal_error, p.parse_success, p.extracted_code, p.skip_reason AS sr, t.shape, a.entry_point, t.entry_point AS task_entry_point
FROM attempts a LEFT JOIN lp p ON a.sample_id = p.sample_id LEFT JOIN tasks t ON a.task_id = t.task_id))""", "attempts", "last", "tasks"))
def test_router(spark, sf_dir):
    """What becomes of each attempt: unknown tasks and broken suites are internal errors."""
    tasks = B.tasks(spark, sf_dir).select("task_id", "shape", "problem", F.col("entry_point").alias("task_entry_point"))
    return K.routed(B.attempts(spark, sf_dir), O.latest(B.parse_outcomes(spark, sf_dir), "sample_id"), tasks).select("pos", "sample_id", "run_id", "internal_error", "route", "skip_reason", "entry_point")


@query(sql("SELECT sha256(string_agg(sample_id || chr(0), '' ORDER BY pos)) AS sample_ids_hash, (SELECT string_agg(task_id, ',' ORDER BY task_id) FROM (SELECT DISTINCT task_id FROM attempts)) AS task_ids, count(*) AS expected_jobs FROM attempts", "attempts"))
def seed_digest(spark, sf_dir):
    return O.seed_digest(B.attempts(spark, sf_dir))


@query(sql("SELECT pos, sample_id, task_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY pos) AS n FROM attempts) WHERE n <= 2", "attempts"))
def per_file_limit(spark, sf_dir):
    return T.limit_per(B.attempts(spark, sf_dir), "task_id", 2).select("pos", "sample_id", "task_id")


@query(sql("SELECT pos, sample_id FROM attempts WHERE pos < (SELECT min(pos) FROM (SELECT pos FROM attempts ORDER BY pos DESC LIMIT 10))", "attempts"))
def negative_slice(spark, sf_dir):
    return T.slice_limit(B.attempts(spark, sf_dir), -10).select("pos", "sample_id")


@query(sql("SELECT x.pos, t.task_id, t.entry_point FROM tasks t JOIN (VALUES (0, 'HumanEval/7'), (1, 'HumanEval/2'), (2, 'HumanEval/31')) x(pos, task_id) ON x.task_id = t.task_id", "tasks").replace("x.pos,", "CAST(x.pos AS BIGINT) AS pos,"))
def task_selection(spark, sf_dir):
    return T.select_tasks(B.tasks(spark, sf_dir), ["HumanEval/7", "HumanEval/2", "HumanEval/31"]).select("pos", "task_id", "entry_point")


@query(sql("SELECT task_id, 'Write functional code in Python according to the description.' || chr(10) || chr(10) || '\"\"\"' || chr(10) || prompt || chr(10) || '\"\"\"' || chr(10) AS decoder_prompt, prompt || canonical_solution AS full_source FROM tasks", "tasks"))
def decoder_prompts(spark, sf_dir):
    return B.tasks(spark, sf_dir).select("task_id", C.decoder_prompt("prompt").alias("decoder_prompt"), C.full_source().alias("full_source"))


_FILE = "CASE WHEN doc_id % 2 = 0 THEN 'dir/human_eval-' || CAST(doc_id % 164 AS VARCHAR) || '-decode-dedup.jsonl' ELSE 'human_eval-' || CAST(doc_id AS VARCHAR) || '-decode.parquet' END"


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'HumanEval/' || regexp_extract({_FILE}, 'human_eval-([0-9]+)-decode-dedup\\.jsonl$', 1) END AS task_id FROM documents")
def filename_task_ids(spark, sf_dir):
    i = F.col("doc_id")
    name = F.when(i % 2 == 0, F.concat(F.lit("dir/human_eval-"), (i % 164).cast("string"), F.lit("-decode-dedup.jsonl"))).otherwise(F.concat(F.lit("human_eval-"), i.cast("string"), F.lit("-decode.parquet")))
    return B.table(spark, sf_dir, "documents").select("doc_id", C.dedup_task_id(name).alias("task_id"))


_NEAR = "CASE l_orderkey % 3 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice * (1 + 1e-10) ELSE l_extendedprice * 1.0001 END"


@query(f"SELECT l_orderkey % 3 AS kind, count(*) AS row_count, CAST(count_if(l_extendedprice = {_NEAR} OR abs(l_extendedprice - ({_NEAR})) <= 1e-9 * greatest(abs(l_extendedprice), abs({_NEAR}))) AS BIGINT) AS close_count FROM lineitem GROUP BY 1")
def numeric_close(spark, sf_dir):
    a, k = F.col("l_extendedprice"), F.col("l_orderkey") % 3
    b = F.when(k == 0, a).when(k == 1, a * (1 + F.lit(1e-10))).otherwise(a * 1.0001)
    return B.table(spark, sf_dir, "lineitem").groupBy(k.alias("kind")).agg(F.count("*").alias("row_count"), F.count_if(C.numbers_close(a, b)).alias("close_count"))


@query()
def sweep_decision(spark, sf_dir):
    days = B.events(spark, sf_dir).where("event = 'terminal'").groupBy((F.dayofyear("ts") % 6 + 1).alias("workers")).agg(F.count("*").cast("double").alias("rate"))
    return E.sweep(days.withColumn("reliable", F.col("rate") >= 10))


ORACLE["sweep_decision"] = sql("""SELECT workers, rate, reliable, previous_rate, CASE WHEN reliable AND previous_rate > 0 THEN (rate - previous_rate) / previous_rate END AS gain, reason, stopped_before,
coalesce(max(CASE WHEN reliable AND NOT stopped_before THEN rate END) OVER (ORDER BY workers ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS best_rate FROM (
SELECT *, coalesce(bool_or(reason IS NOT NULL) OVER (ORDER BY workers ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped_before FROM (
SELECT *, CASE WHEN reliable AND rate < previous_rate THEN 'regression' WHEN reliable AND previous_rate > 0 AND (rate - previous_rate) / previous_rate < 0.1 THEN 'diminishing returns' END AS reason FROM (
SELECT *, last_value(CASE WHEN reliable THEN rate END IGNORE NULLS) OVER (ORDER BY workers ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_rate FROM (
SELECT workers, rate, rate >= 10 AS reliable FROM (SELECT CAST(dayofyear(ts) % 6 + 1 AS INTEGER) AS workers, CAST(count(*) AS DOUBLE) AS rate FROM log WHERE event = 'terminal' GROUP BY 1)))))""", "log")


@query(sql("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')) AS window_us, count(*) AS terminals FROM log WHERE event = 'terminal' GROUP BY 1", "log"))
def throughput_windows(spark, sf_dir):
    return E.windows(B.events(spark, sf_dir)).select(F.unix_micros("window_start").alias("window_us"), "terminals")


@query(sql("""SELECT seq, gap_us FROM (SELECT seq, us - lag(us) OVER (ORDER BY us, seq) AS gap_us FROM log WHERE event = 'terminal')
WHERE gap_us > (SELECT 2 * ((max(us) - min(us)) // greatest(count(*) - 1, 1)) FROM log WHERE event = 'terminal')""", "log"))
def stalls(spark, sf_dir):
    """Gaps of more than twice the mean one."""
    e = B.events(spark, sf_dir)
    r = e.where(F.col("event") == E.TERMINAL).agg(F.min(E.micros("ts")).alias("a"), F.max(E.micros("ts")).alias("b"), F.count("*").alias("n")).first()
    return E.stalls(e, 2 * ((r.b - r.a) // max(r.n - 1, 1)) if r.n else 0, F.to_date("ts"))


@query("SELECT 'run-' || CAST(user_id AS VARCHAR) AS run_id, CASE WHEN user_id % 2 = 0 THEN 'old' ELSE 'new' END AS init, CASE WHEN user_id % 2 = 0 AND user_id % 3 = 0 THEN 'seeded' END AS seed FROM (SELECT DISTINCT user_id FROM events)")
def metadata_insert_if_absent(spark, sf_dir):
    users = B.table(spark, sf_dir, "events").select("user_id").distinct()
    run = F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id")
    there = users.where("user_id % 2 = 0").select(run, F.lit("old").alias("init"), F.when(F.col("user_id") % 3 == 0, "seeded").alias("seed"))
    return O.insert_if_absent(there, users.select(run, F.lit("new").alias("init")))


@query("SELECT 'run-' || CAST(user_id AS VARCHAR) AS run_id, 'init' AS init, CASE WHEN user_id % 3 = 0 THEN 'first' WHEN user_id % 2 = 0 THEN 'second' END AS seed, user_id % 3 <> 0 AND user_id % 2 = 0 AS accepted FROM (SELECT DISTINCT user_id FROM events)")
def seed_compare_and_set(spark, sf_dir):
    users = B.table(spark, sf_dir, "events").select("user_id").distinct()
    run = F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("run_id")
    there = users.select(run, F.lit("init").alias("init"), F.when(F.col("user_id") % 3 == 0, "first").alias("seed"))
    return O.set_seed(there, users.where("user_id % 2 = 0").select(run, F.lit("second").alias("seed")))


@query(sql("SELECT pos, sample_id, run_id, task_id, entry_point, provenance_source, provenance_model, provenance_occurrence_count FROM attempts", "attempts"))
def flat_nested_flat(spark, sf_dir):
    """Flat rows, nested and flattened again."""
    back = C.flattened(C.nested(B.attempts(spark, sf_dir)))
    return back.select("pos", "sample_id", "run_id", "task_id", "entry_point", "provenance_source", "provenance_model", "provenance_occurrence_count")


@query(sql("SELECT coalesce(avg(latency), 0.0) AS mean_latency_ms FROM parse", "parse"))
def mean_latency(spark, sf_dir):
    return K.mean_latency(B.parse_outcomes(spark, sf_dir), "latency")


@query(sql("SELECT " + ", ".join(f"CAST(count_if(outcome_kind = '{k}') AS BIGINT) AS {k}_count" for k in ("skipped", "tested", "infra_error", "internal_error")) + ", CAST(count_if(outcome_kind = 'tested' AND coalesce(all_tests_passed, false)) AS BIGINT) AS pass_count, CAST(count_if(outcome_kind = 'tested' AND NOT coalesce(all_tests_passed, false)) AS BIGINT) AS fail_count FROM test", "test"))
def batch_tally(spark, sf_dir):
    return K.batch_tally(B.test_outcomes(spark, sf_dir))


@query(sql("SELECT task_id, CAST(count_if(is_tested) AS BIGINT) AS tested_count, CAST(count_if(is_passed) AS BIGINT) AS pass_count, CAST(count_if(is_passed) AS DOUBLE) / nullif(count_if(is_tested), 0) AS pass_rate FROM enriched GROUP BY 1", "enriched"))
def task_hardness(spark, sf_dir):
    return S.task_hardness(enriched(spark, sf_dir))


@query(sql("SELECT CASE WHEN all_tests_passed IS NULL THEN 'not_tested' WHEN all_tests_passed THEN 'pass' ELSE 'fail' END AS label, count(*) AS row_count FROM enriched GROUP BY 1", "enriched"))
def pass_labels(spark, sf_dir):
    return enriched(spark, sf_dir).groupBy(C.pass_label("all_tests_passed").alias("label")).agg(F.count("*").alias("row_count"))


@query(sql("SELECT pos, sample_id, outcome_kind FROM test WHERE pos <= coalesce((SELECT min(pos) FROM test WHERE outcome_kind = 'internal_error'), pos)", "test"))
def fail_fast_prefix(spark, sf_dir):
    return K.until_failure(B.test_outcomes(spark, sf_dir)).select("pos", "sample_id", "outcome_kind")


@query(sql("SELECT row_number() OVER (ORDER BY pos) - 1 AS repeat, sample_id, task_id FROM attempts", "attempts"))
def envelope_codec(spark, sf_dir):
    """Jobs made from attempts and opened again; positions are numbered from 0 without sorting all rows in one task."""
    a = B.attempts(spark, sf_dir)
    bucket = F.floor(F.col("pos") / 4096)
    first = a.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("b").orderBy("pos")) - 1
    placed = a.withColumn("b", bucket).withColumn("nth", nth).join(first, "b")
    jobs = C.envelopes(placed.select("sample_id", "task_id", (F.col("before") + F.col("nth")).alias("at")), F.lit("run-1"), "eval", F.col("at"))
    return C.opened(jobs, "sample_id STRING, task_id STRING").select("repeat", "sample_id", "task_id")


@query(sql("SELECT pos, sample_id, CAST(is_passed AS INTEGER) - 0.001 * decoder_input_len_zstd22 AS objective FROM enriched WHERE is_tested", "enriched").replace("0.001", "CAST(0.001 AS DOUBLE)"))
def joint_objective(spark, sf_dir):
    return S.joint_objective(enriched(spark, sf_dir))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(sql("SELECT task_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT task_id FROM attempts UNION ALL SELECT task_id FROM tasks) GROUP BY 1", "attempts", "tasks"))
def bag_union(spark, sf_dir):
    return B.attempts(spark, sf_dir).select("task_id").unionByName(B.tasks(spark, sf_dir).select("task_id")).groupBy("task_id").agg(F.count("*").alias("n"))


@query()
def compression_lengths(spark, sf_dir):
    """Byte length and zstd length of each text (rows only: the frame's size depends on the library)."""
    from ..functions.compress import zstd_length

    return B.attempts(spark, sf_dir).select("pos", F.octet_length("decoder_input").alias("raw"), zstd_length("decoder_input").alias("zstd22"))


def enriched_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched rows with their zstd lengths, and the quartiles by these."""
    sized = O.measured(B.attempts(spark, sf_dir))
    return O.with_quartile(O.enriched(sized, B.parse_outcomes(spark, sf_dir), B.test_outcomes(spark, sf_dir)), sizes=sized)


@query()
def enriched_rows_zstd(spark, sf_dir):
    """Like enriched_rows, by zstd length (rows only, as the next two: SQL has no such length)."""
    return enriched_zstd(spark, sf_dir).select(*_ROW.split(", "), "decoder_input_len_zstd22")


@query()
def slices_all_zstd(spark, sf_dir):
    return S.all_slices(enriched_zstd(spark, sf_dir))


@query()
def joint_objective_zstd(spark, sf_dir):
    return S.joint_objective(enriched_zstd(spark, sf_dir))


def fenced_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts whose output is a small program within or before the document's whole text, wrapped in several ways, as decoders give it."""
    i, text = F.col("pos"), F.col("raw_output")
    n = (i % 41).cast("string")
    code = F.concat(F.lit("def fn_"), n, F.lit("(x):\n    return x + "), F.when(i % 5 == 0, n).otherwise(F.lit("1")), F.lit("\n"))
    out = (
        F.when(i % 7 == 0, F.concat(text, F.lit("\n```python\n"), code, F.lit("```\n"), text))
        .when(i % 7 == 1, F.concat(text, F.lit("\n\n"), code)).when(i % 7 == 2, F.concat(text, F.lit("\n```\n"), code)).when(i % 7 == 3, F.concat(code, F.lit("\nThis works because: "), text))
        .when(i % 7 == 4, F.concat(F.lit("I cannot do that: "), text)).when(i % 7 == 5, F.concat(F.lit("It is ((\n"), text)).otherwise(F.concat(text, F.lit("\n```\n    "), F.regexp_replace(code, "\n", "\n    "), F.lit("\n```\n"), text))
    )
    return B.attempts(spark, sf_dir).withColumn("raw_output", out)


_CODE = "'def fn_' || CAST(doc_id % 41 AS VARCHAR) || '(x):' || chr(10) || '    return x + ' || CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 41 AS VARCHAR) ELSE '1' END"
#: parsed: whether code is found, and whether it adds one, as the cases want.
FENCED = f"""fenced AS (SELECT doc_id AS pos, {_TASK} AS task_id, {_CODE} AS code, doc_id % 7 NOT IN (4, 5) AS parsed, doc_id % 5 <> 0 OR doc_id % 41 = 1 AS adds_one,
'describe' AS decoder_input, 1 + n_chars % 5 AS weight FROM documents)"""


def fenced_sql(body: str, *names: str) -> str:
    return (sql("", *names).rstrip() + f", {FENCED} {body}") if names else f"WITH {FENCED} {body}"


@query(fenced_sql("SELECT pos, task_id, parsed AS parse_success, CASE WHEN parsed THEN code END AS extracted_code, CASE WHEN NOT parsed THEN 'no_valid_candidate' END AS skip_reason, parsed AS has_log, parsed AS has_valid FROM fenced"))
def parse_extract(spark, sf_dir):
    """Parse outcomes of all attempts: code found in, before and without prose, fenced and not, indented; none where there is none."""
    from ..functions.extract import parse_attempts

    rows = fenced_attempts(spark, sf_dir).withColumn("sample_id", F.col("pos").cast("string"))
    out = parse_attempts(rows)
    return out.select(
        F.col("sample_id").cast("long").alias("pos"), "task_id", "parse_success", F.rtrim("extracted_code", F.lit("\n")).alias("extracted_code"), "skip_reason",
        F.coalesce(F.size("code_eval.extractor_path") > 0, F.lit(False)).alias("has_log"), (F.col("valid_count") > 0).alias("has_valid"),
    )


@query(f"""SELECT doc_id AS pos, CASE WHEN doc_id % 7 = 0 THEN {_CODE} || chr(10) ELSE '' END AS fenced_code FROM documents""")
def fenced_code(spark, sf_dir):
    """The first fenced block by a pattern: what SQL can say of extraction."""
    return fenced_attempts(spark, sf_dir).select("pos", F.regexp_extract("raw_output", r"(?s)```python\n(.*?)```", 1).alias("fenced_code"))


CHECK = "def check(candidate):\n    inputs = [[1], [2], [40]]\n    results = [2, 3, 41]\n"
SUITES = "def check(candidate):\n    inputs = [1]\n"


def suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks with test sources: readable ones, ones without results, and broken ones."""
    test = F.when(F.col("shape") == "inputs_results", CHECK).when(F.col("shape") == "inputs_ref_func", SUITES).otherwise("x = 1\n")
    return B.tasks(spark, sf_dir).select("task_id", "entry_point", "prompt", "canonical_solution", test.alias("test"))


def sample_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fenced_attempts; texts repeat, but each attempt is a sample."""
    return fenced_attempts(spark, sf_dir).withColumn("sample_id", C.sample_id(F.concat("task_id", F.lit("#"), F.col("pos").cast("string")), F.lit("")))


#: What becomes of the fenced attempts.
TESTED = """tested AS (SELECT f.*, substr(sha256(f.task_id || '#' || CAST(pos AS VARCHAR) || chr(0)), 1, 16) AS sample_id, CASE WHEN NOT parsed THEN 'skipped' WHEN t.task_id IS NULL OR t.problem IS NOT NULL THEN 'internal_error'
WHEN t.shape = 'inputs_results' THEN 'tested' ELSE 'skipped' END AS outcome_kind, t.entry_point FROM fenced f LEFT JOIN tasks t ON f.task_id = t.task_id)"""


def tested_sql(body: str) -> str:
    return fenced_sql("", "tasks").rstrip() + f", {TESTED} {body}"


@query(tested_sql("""SELECT sample_id, task_id, parsed AS parse_success, outcome_kind, outcome_kind = 'skipped' AS skipped, CASE WHEN outcome_kind = 'skipped' THEN CASE WHEN parsed THEN 'unsupported_test_shape' ELSE 'no_valid_candidate' END END AS skip_reason,
outcome_kind = 'tested' AS tests_ran, CASE WHEN outcome_kind = 'tested' THEN 'fn_' || CAST(pos % 41 AS VARCHAR) WHEN outcome_kind = 'skipped' AND parsed THEN entry_point END AS entry_point,
CASE WHEN outcome_kind = 'tested' THEN CASE WHEN adds_one THEN 1.0 ELSE 0.0 END END AS test_pass_rate, CASE WHEN outcome_kind = 'tested' THEN adds_one END AS all_tests_passed, CAST(CASE WHEN outcome_kind = 'tested' THEN 3 ELSE 0 END AS BIGINT) AS case_count,
outcome_kind = 'internal_error' AS has_internal_error FROM tested""").replace("THEN 1.0 ELSE 0.0 END END", "THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END"))
def test_execute(spark, sf_dir):
    """Test outcomes of all attempts: each executable one runs in a process of its own."""
    from ..functions.sandbox import tasks_for
    from .jobs import parse_attempts, test_attempts

    rows = sample_attempts(spark, sf_dir)
    out = test_attempts(rows, parse_attempts(rows), suites(spark, sf_dir), 10.0, tasks_for(rows.count(), spark.sparkContext.defaultParallelism))
    return out.select(
        "sample_id", "task_id", "parse_success", "outcome_kind", "skipped", "skip_reason", "tests_ran", "entry_point", "test_pass_rate", "all_tests_passed",
        F.size("test_case_results").cast("long").alias("case_count"), F.col("internal_error").isNotNull().alias("has_internal_error"),
    )


_RESULTS = "SELECT sample_id, task_id, outcome_kind, CASE WHEN outcome_kind = 'tested' THEN adds_one END AS all_tests_passed FROM tested"


@query(tested_sql(_RESULTS))
def stream_run(spark, sf_dir):
    """A seeded run as a stream that ends when its jobs are done; as many results as samples."""
    from ..staging import shared_root
    from ..streaming.runs import Run, new_run_id

    run = Run(spark, shared_root(spark), new_run_id())
    return run.run_once(C.nested(sample_attempts(spark, sf_dir)), suites(spark, sf_dir), 10.0).select("sample_id", "task_id", "outcome_kind", "all_tests_passed")


@query(tested_sql(_RESULTS))
def replaced_run(spark, sf_dir):
    """The same where the test worker is stopped after its first batches and replaced by one with another concurrency while parse goes on: nothing is lost or doubled."""
    from ..staging import shared_root
    from ..streaming.runs import Run, new_run_id

    run, tasks = Run(spark, shared_root(spark), new_run_id()), suites(spark, sf_dir)
    run.init()
    run.seed(C.nested(sample_attempts(spark, sf_dir)))
    n = spark.sparkContext.defaultParallelism
    run.start(tasks, "test", 10.0, max_files=1, concurrency=n)
    run.start(tasks, "parse", max_files=1)
    if run.expected():
        run.wait("test", jobs=1, stall_seconds=1800)
    run.replace(tasks, "test", 2 * n, timeout=10.0)
    if run.expected():
        run.wait(stall_seconds=3600)  # a limit on silence, which doesn't grow with the table
    run.stop(seconds=600)
    return run.results().select("sample_id", "task_id", "outcome_kind", "all_tests_passed")


from . import files as _files  # noqa: E402, F401  (registers its queries)
