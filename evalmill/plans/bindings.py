"""The operators' tables as views over a star schema with documents, labels, benchmark, events and lineitem.

Spark and SQL texts of the same tables stand side by side; SQL is for an independent engine that checks results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import sample_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    task = F.concat(F.lit("HumanEval/"), (i % 41).cast("string"))
    return d.select(
        i.alias("pos"), sample_id(task, "text").alias("sample_id"), F.when(i % 5 != 0, F.concat(F.lit("run-"), (i % 2).cast("string"))).alias("run_id"),
        task.alias("task_id"), F.concat(F.lit("fn_"), (i % 41).cast("string")).alias("entry_point"), F.col("text").alias("decoder_input"), F.col("text").alias("raw_output"),
        F.when(i % 3 == 0, "pool").when(i % 3 == 1, "fresh_stub").otherwise("bottleneck").alias("provenance_source"),
        F.when(i % 7 == 0, None).when(i % 11 == 0, "").otherwise(F.col("source")).alias("provenance_model"),
        (1 + F.col("n_chars") % 5).alias("provenance_occurrence_count"),
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    task = F.concat(F.lit("HumanEval/"), (i % 41).cast("string"))
    rows = table(spark, sf_dir, "labels").join(d.select("doc_id", sample_id(task, "text").alias("sample_id"), task.alias("task_id")), "doc_id")
    # every tenth row comes twice: the second copy, with the other quality, is the newer one
    copy = F.explode(F.when(i % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy")
    again = F.col("__copy") == 1
    return rows.select("*", copy).select("doc_id", F.when(again, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"), "toxic", "sample_id", "task_id", (i * 2 + F.col("__copy")).alias("pos"), F.when(i % 4 != 0, F.concat(F.lit("run-"), (i % 3).cast("string"))).alias("run_id"))


def parse_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    ok = F.col("quality") == 1
    return rows.select("pos", "sample_id", "run_id", "task_id", ok.alias("parse_success"), F.when(~ok, "no_valid_candidate").alias("skip_reason"), F.when(ok & (F.col("doc_id") % 19 != 0), F.concat(F.lit("code "), F.col("doc_id").cast("string"))).alias("extracted_code"), (F.col("doc_id") % 50).cast("long").alias("latency"))


def test_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    kind = F.when(F.col("quality") == 0, "skipped").when(F.col("toxic") == 1, "infra_error").when(i % 13 == 0, "internal_error").otherwise("tested")
    ran = kind == "tested"
    passed = F.when(ran & (i % 17 != 0), i % 3 != 0)
    return _labelled(spark, sf_dir).select(
        "pos", "sample_id", "run_id", "task_id", kind.alias("outcome_kind"), ran.alias("tests_ran"), passed.alias("all_tests_passed"),
        F.when(ran, (i % 4).cast("double") / 4).alias("test_pass_rate"), (kind == "skipped").alias("skipped"), F.when(kind == "skipped", "no_valid_candidate").alias("skip_reason"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items; item 40 has a name of its own, so attempts of HumanEval/40 have no task. Some suites can't be read."""
    i, n = F.col("item_id"), F.col("item_id").cast("string")
    broken = i % 13 == 5
    return table(spark, sf_dir, "benchmark").select(
        F.when(i == 40, "Other/40").otherwise(F.concat(F.lit("HumanEval/"), n)).alias("task_id"), F.concat(F.lit("task_fn_"), n).alias("entry_point"), F.col("text").alias("prompt"), F.concat(F.lit("    return "), n).alias("canonical_solution"),
        F.when(broken, None).when(i % 3 == 0, "inputs_ref_func").otherwise("inputs_results").alias("shape"), F.when(broken, "ValueError: no check function").alias("problem"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("run-"), (F.col("user_id") % 2).cast("string")).alias("run_id"), F.col("user_id").alias("job_id"),
        F.when(kind.isin("signup", "click"), "parse").otherwise("test").alias("stage"),
        F.when(kind.isin("signup", "view"), "stage_started").when(kind.isin("click", "purchase"), "stage_output").otherwise("terminal").alias("event"), "ts",
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("HumanEval/"), (F.col("user_id") % 41).cast("string"))).alias("task_id"), "value", "props",
    )


#: What cases of an order say: messages of broken sandboxes, and one of a candidate.
MESSAGES = ("worker exited with rc=1", "Fork failed: no memory", "Worker timed out after 3s", "worker returned no output", "Missing results list", "ValueError: worker")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its cases; their order in the array is not fixed. Messages of broken sandboxes and one that only looks like it take turns."""
    flag, kind = F.col("l_returnflag"), F.col("l_orderkey") % len(MESSAGES)
    said = F.element_at(F.array(*map(F.lit, MESSAGES)), (kind + 1).cast("int"))
    case = F.struct((flag == "A").alias("passed"), F.when(flag == "R", None).when(F.col("l_linestatus") == "F", said).otherwise("other").alias("error"), F.lit(None).cast("string").alias("compile_error"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(case).alias("test_case_results"))


_TASK = "'HumanEval/' || CAST(doc_id % 41 AS VARCHAR)"
_RUN = "CASE WHEN doc_id % {0} <> 0 THEN 'run-' || CAST(doc_id % {1} AS VARCHAR) END"

SQL = {
    "attempts": f"""attempts AS (SELECT doc_id AS pos, substr(sha256({_TASK} || chr(0) || text), 1, 16) AS sample_id, {_RUN.format(5, 2)} AS run_id, {_TASK} AS task_id,
  'fn_' || CAST(doc_id % 41 AS VARCHAR) AS entry_point, text AS decoder_input, text AS raw_output,
  CASE doc_id % 3 WHEN 0 THEN 'pool' WHEN 1 THEN 'fresh_stub' ELSE 'bottleneck' END AS provenance_source,
  CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '' ELSE source END AS provenance_model, 1 + n_chars % 5 AS provenance_occurrence_count FROM documents)""",
    "labelled": f"""l0 AS (SELECT l.doc_id, quality, toxic, substr(sha256({_TASK.replace("doc_id", "l.doc_id")} || chr(0) || text), 1, 16) AS sample_id, {_TASK.replace("doc_id", "l.doc_id")} AS task_id FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
labelled AS (SELECT *, doc_id * 2 AS pos, {_RUN.format(4, 3)} AS run_id FROM l0 UNION ALL SELECT doc_id, 1 - quality, toxic, sample_id, task_id, doc_id * 2 + 1, {_RUN.format(4, 3)} FROM l0 WHERE doc_id % 10 = 0)""",
    "parse": """parse AS (SELECT pos, sample_id, run_id, task_id, quality = 1 AS parse_success, CASE WHEN quality <> 1 THEN 'no_valid_candidate' END AS skip_reason,
  CASE WHEN quality = 1 AND doc_id % 19 <> 0 THEN 'code ' || CAST(doc_id AS VARCHAR) END AS extracted_code, doc_id % 50 AS latency FROM labelled)""",
    "test": """t0 AS (SELECT *, CASE WHEN quality = 0 THEN 'skipped' WHEN toxic = 1 THEN 'infra_error' WHEN doc_id % 13 = 0 THEN 'internal_error' ELSE 'tested' END AS outcome_kind FROM labelled),
test AS (SELECT pos, sample_id, run_id, task_id, outcome_kind, outcome_kind = 'tested' AS tests_ran, CASE WHEN outcome_kind = 'tested' AND doc_id % 17 <> 0 THEN doc_id % 3 <> 0 END AS all_tests_passed,
  CASE WHEN outcome_kind = 'tested' THEN CAST(doc_id % 4 AS DOUBLE) / 4 END AS test_pass_rate, outcome_kind = 'skipped' AS skipped, CASE WHEN outcome_kind = 'skipped' THEN 'no_valid_candidate' END AS skip_reason FROM t0)""",
    "last": """lp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos DESC) AS rn FROM parse) WHERE rn = 1),
lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos DESC) AS rn FROM test) WHERE rn = 1)""",
    "enriched": """e0 AS (SELECT a.*, p.sample_id IS NOT NULL AND (a.run_id IS NULL OR p.run_id IS NULL OR a.run_id = p.run_id) AS has_parse_outcome,
  t.sample_id IS NOT NULL AND (a.run_id IS NULL OR t.run_id IS NULL OR a.run_id = t.run_id) AS has_test_outcome, p.parse_success AS ps, p.skip_reason AS pr,
  t.outcome_kind AS tk, t.tests_ran AS tr, t.all_tests_passed AS tp, t.test_pass_rate AS trate, t.skipped AS ts, t.skip_reason AS tsr
  FROM attempts a LEFT JOIN lp p ON a.sample_id = p.sample_id LEFT JOIN lt t ON a.sample_id = t.sample_id),
e1 AS (SELECT pos, sample_id, run_id, task_id, entry_point, CAST(octet_length(encode(decoder_input)) AS BIGINT) AS decoder_input_len_raw, CAST(octet_length(encode(decoder_input)) AS BIGINT) AS decoder_input_len_zstd22,
  provenance_source, provenance_model, provenance_occurrence_count, CASE WHEN has_parse_outcome THEN ps END AS parse_success, CASE WHEN has_parse_outcome THEN pr END AS parse_skip_reason, has_test_outcome, has_parse_outcome,
  CASE WHEN has_test_outcome THEN tk END AS outcome_kind, CASE WHEN has_test_outcome THEN tr END AS tests_ran, CASE WHEN has_test_outcome THEN tp END AS all_tests_passed, CASE WHEN has_test_outcome THEN trate END AS test_pass_rate,
  CASE WHEN has_test_outcome THEN ts END AS skipped, CASE WHEN has_test_outcome THEN tsr END AS skip_reason FROM e0),
cuts AS (SELECT v[CAST(round_even(0.25 * (n - 1), 0) AS BIGINT) + 1] AS p25, CAST(floor((v[CAST(floor((n - 1) / 2.0) AS BIGINT) + 1] + v[CAST(floor(n / 2.0) AS BIGINT) + 1]) / 2.0) AS BIGINT) AS p50, v[CAST(round_even(0.75 * (n - 1), 0) AS BIGINT) + 1] AS p75
  FROM (SELECT list_sort(list(decoder_input_len_zstd22)) AS v, count(*) AS n FROM e1)),
enriched AS (SELECT e1.*, CASE WHEN decoder_input_len_zstd22 <= p25 THEN 'Q1' WHEN decoder_input_len_zstd22 <= p50 THEN 'Q2' WHEN decoder_input_len_zstd22 <= p75 THEN 'Q3' ELSE 'Q4' END AS compression_quartile,
  has_test_outcome AND coalesce(outcome_kind = 'tested', false) AS is_tested, has_test_outcome AND coalesce(outcome_kind = 'tested', false) AND coalesce(all_tests_passed, false) AS is_passed FROM e1, cuts)""",
    "tasks": """tasks AS (SELECT CASE WHEN item_id = 40 THEN 'Other/40' ELSE 'HumanEval/' || CAST(item_id AS VARCHAR) END AS task_id, 'task_fn_' || CAST(item_id AS VARCHAR) AS entry_point, text AS prompt, '    return ' || CAST(item_id AS VARCHAR) AS canonical_solution,
  CASE WHEN item_id % 13 = 5 THEN NULL WHEN item_id % 3 = 0 THEN 'inputs_ref_func' ELSE 'inputs_results' END AS shape, CASE WHEN item_id % 13 = 5 THEN 'ValueError: no check function' END AS problem FROM benchmark)""",
    "log": """log AS (SELECT event_id AS seq, 'run-' || CAST(user_id % 2 AS VARCHAR) AS run_id, user_id AS job_id, CASE WHEN event_type IN ('signup', 'click') THEN 'parse' ELSE 'test' END AS stage,
  CASE WHEN event_type IN ('signup', 'view') THEN 'stage_started' WHEN event_type IN ('click', 'purchase') THEN 'stage_output' ELSE 'terminal' END AS event, ts, epoch_us(ts) AS us,
  CASE WHEN event_id % 3 <> 0 THEN 'HumanEval/' || CAST(user_id % 41 AS VARCHAR) END AS task_id, value, props FROM events)""",
    "timing": """s0 AS (SELECT *, last_value(CASE WHEN event = 'stage_started' THEN us END IGNORE NULLS) OVER (PARTITION BY job_id, stage ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start FROM log WHERE event <> 'terminal'),
timing AS (SELECT job_id, stage, arg_max(us - start, seq) AS latency_us FROM s0 WHERE event = 'stage_output' AND start IS NOT NULL GROUP BY job_id, stage)""",
    "jobtasks": "jobtasks AS (SELECT job_id, arg_max(task_id, seq) AS task_id FROM log WHERE event = 'terminal' AND task_id IS NOT NULL GROUP BY job_id)",
}
NEEDS = {"parse": ("labelled",), "test": ("labelled",), "last": ("parse", "test"), "enriched": ("attempts", "last"), "timing": ("log",), "jobtasks": ("log",)}


def sql(body: str, *names: str) -> str:
    """A query with the tables it needs before it."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return f"WITH {', '.join(SQL[n] for n in order)} {body}" if order else body
