"""Readers of pools, attempts, outcomes and event logs. Each gives pos, the row's place in the source, where order matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.outcomes import first, latest
from ..operators.stats import limit_per, strict_tasks
from ..staging import exists
from ..schemas import ATTEMPTS, DEDUP, EVENTS, PARSE_OUTCOMES, TEST_OUTCOMES, cast_to, only_keys


def in_order(df: DataFrame, *keep: str) -> DataFrame:
    """df with pos: file, place of the split in it, and the row's number, as one sortable value.

    Row numbers grow within a partition and so within a split; files that are read as a whole keep their lines' order.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select(*(keep or df.columns), place.alias("pos"))


def pool_parquet(spark: SparkSession, path: str, tasks: DataFrame, limit: int | None = None) -> DataFrame:
    """Pool rows as attempts; their task must be known. A limit is looked at after each row, so it keeps one at least."""
    rows = in_order(spark.read.parquet(path))
    if limit is not None:
        rows = rows.orderBy("pos").limit(max(limit, 1))
    known = strict_tasks(rows.withColumnRenamed("human_eval_task_id", "task_id"), tasks.select("task_id", "entry_point")).withColumnRenamed("task_id", "human_eval_task_id")
    return C.from_pool(known, keep=("pos",))


def dedup_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Rows out, count, task_id (from the file's name), pos; blank lines don't count."""
    raw = spark.read.schema(DEDUP).option("mode", "FAILFAST").json(path)
    rows = raw.select("out", "count", C.dedup_task_id(F.col("_metadata.file_path")).alias("task_id"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos"))
    return rows if limit is None else limit_per(rows, "task_id", limit)


def _dedup_attempts(rows: DataFrame, decoder_input: Column, **parts: Column) -> DataFrame:
    extra = parts.pop("extra", None)
    made = C.provenance("pool", F.col("count"), extra, **parts)
    return rows.select(*C.attempt("task_id", "entry_point", decoder_input, "out", made), "pos")


def pool_dedup(spark: SparkSession, path: str, tasks: DataFrame, decoder_input: str | None = None, limit: int | None = None) -> DataFrame:
    """Dedup rows as attempts, with the task's prompt (or one text for all) as decoder input."""
    rows = strict_tasks(dedup_jsonl(spark, path, limit), tasks.select("task_id", "entry_point", "prompt"))
    return _dedup_attempts(rows, F.col("prompt") if decoder_input is None else F.lit(decoder_input))


def pool_dedup_with_parquet(spark: SparkSession, path: str, pool_path: str, tasks: DataFrame, limit: int | None = None) -> DataFrame:
    """Dedup rows with the input and provenance of the first pool row of the same text, if there is one; the count is the dedup's."""
    rows = strict_tasks(dedup_jsonl(spark, path, limit), tasks.select("task_id", "entry_point", "prompt"))
    pool = in_order(spark.read.parquet(pool_path))
    side = first(pool.withColumnRenamed("raw_code_output", "out"), "out")
    parts = {to: F.col(c) for c, to in C.POOL_MAPPING.items() if c in pool.columns}
    extra = C.residual(pool.drop("pos"))
    side = side.select("out", F.col("decoder_input_description").alias("__input"), F.struct(*(c.alias(k) for k, c in parts.items()), extra.alias("extra")).alias("__p"))
    joined = rows.join(side, "out", "left")
    taken = {k: F.col(f"__p.{k}") for k in parts}
    return _dedup_attempts(joined, F.coalesce("__input", "prompt"), extra=F.coalesce("__p.extra", F.create_map().cast("map<string,string>")), **taken)


def proof_attempts(spark: SparkSession, dump_dir: str, task_indices: list[int], tasks: DataFrame, run_id: str | None = None, limit_per_task: int | None = None) -> DataFrame:
    """The dedup files of the given tasks, joined with their pool files, in the order of the indices. A missing file is an error of the reader."""
    out = None
    for n, i in enumerate(task_indices):
        base = f"{dump_dir}/per_elem/human_eval-{i}-decode"
        one = pool_dedup_with_parquet(spark, f"{base}-dedup.jsonl", f"{base}.parquet", tasks, limit_per_task)
        one = one.select(*(c for c in one.columns if c != "pos"), F.struct(F.lit(n).alias("file"), F.col("pos.block").alias("block"), F.col("pos.row").alias("row")).alias("pos"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no task indices")
    return out if run_id is None else C.stamped(out, run_id)


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a closed schema: an unknown key or a broken line is an error."""
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(schema)]
    lines = spark.read.text(path).where(F.trim("value") != "")
    checked = lines.select(only_keys("value", names).alias("line"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("pos"))
    return checked.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r"), "pos").select("r.*", "pos")


def attempts(spark: SparkSession, path: str) -> DataFrame:
    """Attempts of an export, by its suffix: flat Parquet or nested JSON lines."""
    if path.endswith(".parquet"):
        raw = spark.read.parquet(path)
        if not raw.columns:  # a writer that infers schemas leaves no columns for no rows
            return spark.createDataFrame([], ATTEMPTS)
        return C.nested(in_order(raw))
    if path.endswith(".jsonl"):
        return strict_json(spark, path, ATTEMPTS)
    raise ValueError(f"attempts are read from .parquet or .jsonl, not {path}")


def outcomes(spark: SparkSession, path: str, schema: str, last: bool = True) -> DataFrame:
    """Outcomes of JSON lines; last: only the last line of each sample. A file that isn't there has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, pos STRUCT<file: STRING, block: BIGINT, row: BIGINT>")
    rows = strict_json(spark, path, schema)
    return latest(rows, "sample_id") if last else rows


def parse_outcomes(spark: SparkSession, path: str, last: bool = True) -> DataFrame:
    return outcomes(spark, path, PARSE_OUTCOMES, last)


def test_outcomes(spark: SparkSession, path: str, last: bool = True) -> DataFrame:
    return outcomes(spark, path, TEST_OUTCOMES, last)


def events(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """The event log, in the order of its lines."""
    rows = spark.read.schema(EVENTS).json(path)
    attempt = lambda c: F.get_json_object("payload", f"$.payload.attempt.{c}").alias(c)
    rows = rows.select("*", attempt("task_id"), attempt("sample_id"), F.to_timestamp("timestamp").alias("ts"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq"))
    return rows if run_id is None else rows.where(F.col("run_id") == run_id)


def stage_jobs(jobs: DataFrame, run_id: str, stage: str) -> DataFrame:
    """Attempts of a stage's jobs, by their place."""
    return C.opened(jobs.where((F.col("run_id") == run_id) & (F.col("stage") == stage)), ATTEMPTS).orderBy("repeat")


def parse_from_events(events_: DataFrame) -> DataFrame:
    """Parse outcomes in stage_output events of stage parse; what is delivered twice stays twice."""
    record = F.get_json_object("payload", "$.step_record")
    rows = events_.where((F.col("event") == "stage_output") & (F.col("stage") == "parse") & record.isNotNull())
    return rows.select("seq", F.from_json(record, PARSE_OUTCOMES).alias("r")).select("r.*", F.col("seq").alias("pos"))


def tests_from_events(events_: DataFrame) -> DataFrame:
    """Test outcomes in terminal events."""
    record = F.get_json_object("payload", "$.step_records.test")
    rows = events_.where((F.col("event") == "terminal") & record.isNotNull())
    return rows.select("seq", F.from_json(record, TEST_OUTCOMES).alias("r")).select("r.*", F.col("seq").alias("pos"))


def flat_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table as a schema wants it, whatever its writer inferred (void columns, or none for no rows); without the file, no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return cast_to(spark.read.parquet(path), schema)


def bundle_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """How the attempts of an analysis bundle came out: five columns of its enriched rows, no other is read; without a bundle, no rows."""
    return flat_table(spark, f"{path}/enriched.parquet", "sample_id string, has_test_outcome boolean, outcome_kind string, all_tests_passed boolean, provenance_occurrence_count bigint")
