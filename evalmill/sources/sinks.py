"""Writers: attempts, outcomes, analysis bundles, and the keyed table of results."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import outcomes as O
from ..operators import slices as S
from ..operators.stats import numbered
from ..schemas import checked_outcomes
from ..staging import file_system, staged
from .documents import write_document, write_document_with_lists
from .versions import Table


def write_attempts(attempts: DataFrame, path: str, compression: str | None = None) -> None:
    """By suffix: flat Parquet, or nested JSON lines with nulls kept."""
    rows = attempts.drop("pos")
    if path.endswith(".parquet"):
        C.flattened(rows).write.mode("overwrite").parquet(path)
    elif path.endswith(".jsonl"):
        write_json_lines(rows, path, compression)
    else:
        raise ValueError(f"attempts are written to .parquet or .jsonl, not {path}")


def write_json_lines(rows: DataFrame, path: str, compression: str | None = None) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path, compression=compression)


def write_dedup(rows: DataFrame, folder: str) -> None:
    """rows: task_id (HumanEval/<n>), out, count. One file of JSON lines for each task, named by it; tasks are some hundred."""
    n = F.regexp_extract("task_id", r"(\d+)$", 1).alias("n")
    rows.select("out", "count", n).repartition("n").write.mode("overwrite").partitionBy("n").json(folder)
    glob, fs = file_system(rows.sparkSession, f"{folder}/n=*/*.json")
    for f in fs.globStatus(glob) or []:
        at = f.getPath()
        name = f"{folder}/human_eval-{at.getParent().getName().removeprefix('n=')}-decode-dedup.jsonl"
        if not fs.rename(at, file_system(rows.sparkSession, name)[0]):
            raise OSError(f"cannot write {name}")


#: Ids without an outcome up to which export_analysis() gives them back; its document and tables have all.
LISTED = 100_000


def export_analysis(rows: DataFrame, path: str, listed: int = LISTED) -> dict[str, Any]:
    """enriched.parquet, aggregates/<name>.parquet, missing/<parse, test>.parquet and summary.json.

    rows are used again and again, so they come back from the written table. The slices are one aggregation, told apart by name.
    The summary counts and lists all missing ids, like the tables; what is given back lists them up to a bound.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/enriched.parquet")
    rows = spark.read.parquet(f"{path}/enriched.parquet")
    slices = staged(S.all_slices(rows), "slices")
    for name in S.slice_keys():
        slices.where(F.col("slice_name") == name).drop("slice_name").coalesce(1).write.mode("overwrite").parquet(f"{path}/aggregates/{name}.parquet")
    one, kinds, steps = S.summary(rows).first().asDict(), S.outcome_kinds(rows).collect(), S.funnel(rows).first().asDict()
    failures, told, lists = {}, {}, {}
    for which in ("parse", "test"):
        O.missing(rows, which).write.mode("overwrite").parquet(f"{path}/missing/{which}.parquet")
        ids = spark.read.parquet(f"{path}/missing/{which}.parquet")
        count, name = {f"missing_{which}_count": ids.count()}, f"missing_{which}_sample_ids"
        failures |= count | {name: [r.sample_id for r in ids.orderBy("pos").limit(listed).collect()]}
        told |= count | {name: [f"{name} {path}"] if count[f"missing_{which}_count"] else []}
        if told[name]:
            lists[told[name][0]] = numbered(ids, "at").select("at", F.col("sample_id").alias("value"))
    summary = one | {
        "outcome_kind_counts": {r.outcome_kind: r.row_count for r in kinds}, "outcome_kind_counts_weighted": {r.outcome_kind: r.weighted_count for r in kinds},
        "parse_funnel": steps, "join_failures": failures, "joint_objective_preview": {"formula": "pass - lambda * zstd bytes", "lambda_default": S.JOINT_LAMBDA},
    }
    write_document_with_lists(spark, summary | {"join_failures": told}, lists, f"{path}/summary.json")
    return summary


def write_json_lines_as_done(parts: Iterable[DataFrame], path: str) -> None:
    """Rows of several frames, each appended as soon as it is computed: what is done stays when a later one fails."""
    for k, part in enumerate(parts):
        part.write.mode("append" if k else "overwrite").option("ignoreNullFields", False).json(path)


def upsert(results: DataFrame, path: str, key: tuple[str, ...] = ("run_id", "sample_id")) -> int:
    """Put results into the versioned table at a path: per key the row with the largest pos holds, of equals the new one. The version that has them."""
    return Table(results.sparkSession, path, key).upsert(results)


def write_bucketed(outcomes: DataFrame, name: str, path: str, buckets: int) -> None:
    """Outcomes as a table laid out by sample: the last record of each sample, and joins by sample, need no shuffle of it."""
    outcomes.repartition(buckets, "sample_id").write.bucketBy(buckets, "sample_id").sortBy("sample_id").option("path", path).mode("overwrite").saveAsTable(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: str, buckets: int) -> DataFrame:
    """The same table in a session whose catalog doesn't know it."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({schema}) USING parquet CLUSTERED BY (sample_id) SORTED BY (sample_id) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def export_run(path: str, attempts: DataFrame, parse: DataFrame, test: DataFrame, manifest: dict[str, Any], report: dict[str, Any]) -> dict[str, str]:
    """A run's bundle; the proof report only if some jobs have ended, and as many as were expected. Lines are compressed (gzip), as readers of JSON lines take them by their suffix."""
    spark = attempts.sparkSession
    paths = {"attempts": f"{path}/attempts.jsonl", "parse": f"{path}/parse_outcomes.jsonl", "test": f"{path}/test_outcomes.jsonl", "manifest": f"{path}/manifest.json"}
    write_attempts(attempts, paths["attempts"], "gzip")
    write_json_lines(parse.drop("pos"), paths["parse"], "gzip")
    write_json_lines(checked_outcomes(test.drop("pos")), paths["test"], "gzip")
    write_document(spark, manifest, paths["manifest"])
    if report["terminal_count"] and report["terminal_count"] >= report["expected_jobs"]:
        paths["proof_report"] = f"{path}/proof_report.json"
        write_document(spark, report, paths["proof_report"])
    return paths
