import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evalmill.functions import columns as C
from evalmill.functions.compress import zstd_length
from evalmill.operators import events as E
from evalmill.schemas import ATTEMPTS, TASKS
from evalmill.sources import attempts as A
from evalmill.sources import sinks
from evalmill.sources.tasks import Profiles, get, snapshot, write_snapshot

FENCED = "```python\ndef widest(spans):\n    return max(b - a for a, b in spans)\n```"
DEDUP = [(FENCED, 42), ("def widest(spans):\n    return 0\n", 7), ("def widest(spans):\n    return len(spans)\n", 3)]


@pytest.fixture
def tasks(spark):
    return spark.createDataFrame([("HumanEval/0", "widest", "def widest(spans):\n", "    return 0", "x"), ("HumanEval/1", "g", "p1", "s1", "y")], TASKS)


@pytest.fixture
def pool(spark, tmp_path):
    rows = [("HumanEval/0", "the widest span: first", FENCED, "m", "budget", "keep-me"), ("HumanEval/0", "second", FENCED, "m", "other", None), ("HumanEval/1", "third", "x = 1", None, "budget", "k"), ("HumanEval/1", "fourth", "y", "m", None, "k")]
    path = str(tmp_path / "dump/per_elem/human_eval-0-decode.parquet")
    spark.createDataFrame(rows, "human_eval_task_id string, decoder_input_description string, raw_code_output string, model string, pool_name string, extra_col string").coalesce(1).write.parquet(path)
    (tmp_path / "dump/per_elem/human_eval-0-decode-dedup.jsonl").write_text("\n\n".join(json.dumps({"out": o, "count": n}) for o, n in DEDUP) + "\n")
    return path, str(tmp_path / "dump/per_elem/human_eval-0-decode-dedup.jsonl"), str(tmp_path / "dump")


def test_pool(spark, tasks, pool):
    rows = A.pool_parquet(spark, pool[0], tasks).orderBy("pos").collect()
    assert len(rows) == 4 and rows[0].entry_point == "widest" and {r.provenance.source for r in rows} == {"pool"}
    assert rows[0].provenance.extra == {"extra_col": "keep-me"} and rows[1].provenance.extra == {}
    assert rows[0].sample_id == hashlib.sha256(f"HumanEval/0\0{FENCED}".encode()).hexdigest()[:16]
    assert A.pool_parquet(spark, pool[0], tasks, limit=0).count() == 1
    with pytest.raises(Exception, match="unknown task"):
        A.pool_parquet(spark, pool[0], tasks.where("task_id <> 'HumanEval/1'")).collect()


def test_dedup(spark, tasks, pool):
    rows = A.pool_dedup(spark, pool[1], tasks).orderBy("pos").collect()
    assert [r.provenance.occurrence_count for r in rows] == [42, 7, 3] and rows[0].task_id == "HumanEval/0"
    joined = A.pool_dedup_with_parquet(spark, pool[1], pool[0], tasks).orderBy("pos").collect()
    assert joined[0].provenance.pool_name == "budget" and joined[0].decoder_input == "the widest span: first" and joined[0].provenance.occurrence_count == 42
    assert joined[2].decoder_input.startswith("def widest") and joined[2].provenance.pool_name is None
    run = A.proof_attempts(spark, pool[2], [0], tasks, "run-9", 2).collect()
    assert len(run) == 2 and {r.run_id for r in run} == {"run-9"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        A.proof_attempts(spark, pool[2], [5], tasks).collect()


@pytest.mark.parametrize("suffix", ["parquet", "jsonl"])
def test_round_trip(spark, tasks, pool, tmp_path, suffix):
    a = A.pool_parquet(spark, pool[0], tasks).drop("pos")
    path = str(tmp_path / f"attempts.{suffix}")
    sinks.write_attempts(a, path)
    back = A.attempts(spark, path).drop("pos")
    key = lambda df: sorted(map(repr, (r.asDict(True) for r in df.collect())))
    assert key(back) == key(a)


def test_strict_reader(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text(json.dumps({"sample_id": "s", "odd": 1}) + "\n")
    with pytest.raises(Exception, match="unknown keys: odd"):
        A.attempts(spark, str(tmp_path / "bad.jsonl")).collect()
    with pytest.raises(ValueError, match="parquet or .jsonl"):
        A.attempts(spark, "x.csv")


def test_lenient_flat_reader(spark):
    flat = spark.createDataFrame([("s", "t", "e", "d", "r", "1.0", "[1]")], "sample_id string, task_id string, entry_point string, decoder_input string, raw_output string, provenance_occurrence_count string, provenance_extra_json string")
    r = C.nested(flat).first()
    assert r.provenance.occurrence_count == 1 and r.provenance.extra == {} and r.run_id is None and C.nested(flat).schema.simpleString() == spark.createDataFrame([], ATTEMPTS).schema.simpleString()


def test_outcomes_last_wins(spark, tmp_path):
    base = {"sample_id": "s", "run_id": None, "task_id": "t", "parse_success": True}
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(base | {"parse_success": x}) for x in (True, False)))
    assert [r.parse_success for r in A.parse_outcomes(spark, str(tmp_path / "p.jsonl")).collect()] == [False]
    assert A.parse_outcomes(spark, str(tmp_path / "p.jsonl"), last=False).count() == 2


def test_events_hold_outcomes(spark, tmp_path):
    event = lambda stage, kind, payload: json.dumps({"run_id": "r", "job_id": "j", "lane": "default", "stage": stage, "event": kind, "timestamp": "2026-01-01T00:00:00.5+00:00", "payload": payload})
    (tmp_path / "e.json").write_text("\n".join([event("parse", "stage_output", {"step_record": {"sample_id": "s", "parse_success": True}}), event("test", "terminal", {"step_records": {"test": {"sample_id": "s", "outcome_kind": "tested"}}})]))
    e = A.events(spark, str(tmp_path / "e.json"), "r")
    assert A.parse_from_events(e).first().parse_success and A.tests_from_events(e).first().outcome_kind == "tested"
    assert e.first().ts.microsecond == 500000


def test_tasks_and_profiles(spark, tasks, tmp_path):
    write_snapshot(tasks, str(tmp_path / "snap"))
    back = snapshot(spark, str(tmp_path / "none"), str(tmp_path / "snap"))
    assert back.count() == 2 and get(back, "HumanEval/1").entry_point == "g"
    with pytest.raises(KeyError):
        get(back, "x")
    with pytest.raises(FileNotFoundError):
        snapshot(spark, str(tmp_path / "none"))
    (tmp_path / "p.yaml").write_text("defaults:\n  temperature: 0.7\n  top_p: 0.95\n\nprofiles:\n  a/b:off/v1:\n    model: a/b\n    reasoning_disabled: true\n  c/low:\n    model: c\n    effort: low\n")
    p = Profiles.load(str(tmp_path / "p.yaml"))
    assert p.ids() == ["a/b:off/v1", "c/low"] and p.resolve("c/low")["reasoning"] == {"effort": "low"} and p.table(spark).count() == 2
    with pytest.raises(ValueError, match="allowed"):
        p.resolve("z")


def test_scalars(spark):
    d = spark.createDataFrame([("a\nb", "abcdefgh", None)], "t string, s string, m string")
    r = d.select(C.indented("t", 2).alias("i"), C.truncated("s", 6).alias("c"), C.or_unknown("m").alias("u"), C.decoder_prompt("s").alias("p"), zstd_length(F.lit("hello world")).alias("z"), C.parsed_list(F.lit(" 1, ,2 ")).alias("l")).first()
    assert (r.i, r.c, r.u, r.z, r.l) == ("  a\n  b", "abc...", "(unknown)", 20, ["1", "2"]) and r.p.endswith('"""\nabcdefgh\n"""\n')


def test_absent_files_are_empty(spark, tmp_path):
    assert A.parse_outcomes(spark, str(tmp_path / "none.jsonl")).count() == 0 and A.test_outcomes(spark, str(tmp_path / "none.jsonl"), last=False).count() == 0
    assert A.flat_table(spark, str(tmp_path / "none.parquet"), TASKS).count() == 0
    assert A.bundle_outcomes(spark, str(tmp_path / "none")).count() == 0


def test_bundle_outcomes_read_their_columns_only(spark, tmp_path):
    """Columns that the writer left void are null as they should be, and the scan has no others."""
    spark.sql("SELECT 's' AS sample_id, CAST(NULL AS STRING) AS outcome_kind, true AS all_tests_passed, CAST(2 AS INT) AS provenance_occurrence_count, 'long' AS text").write.parquet(str(tmp_path / "enriched.parquet"))
    rows = A.bundle_outcomes(spark, str(tmp_path))
    assert [tuple(r) for r in rows.collect()] == [("s", None, None, True, 2)]
    scan = next(line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "text" not in scan.split("ReadSchema")[1] and "all_tests_passed" in scan.split("ReadSchema")[1]


def test_events_of_a_file_tell_their_attempts(spark, tmp_path):
    event = lambda job, attempt: json.dumps({"run_id": "r", "job_id": job, "lane": "default", "stage": "test", "event": "terminal", "timestamp": "2026-01-01T00:00:00+00:00", "payload": json.dumps({"payload": {"attempt": attempt}})})
    (tmp_path / "e.json").write_text("\n".join([event("j1", {"task_id": "t1"}), event("j2", {"sample_id": "s2"}), event("j3", {"sample_id": "unknown"})]))
    attempts = spark.createDataFrame([(0, "s2", "t2", 1)], "pos long, sample_id string, task_id string, provenance_occurrence_count long")
    e = A.events(spark, str(tmp_path / "e.json"), "r")
    assert {(r.job_id, r.task_id) for r in E.job_tasks(e, attempts).collect()} == {("j1", "t1"), ("j2", "t2")}
    none = spark.createDataFrame([], "pos long, sample_id string, parse_success boolean, outcome_kind string, all_tests_passed boolean")
    assert E.metrics_report("r", 3, e, attempts, none, none)["terminal_count"] == 3


def test_constructors(spark):
    t = spark.createDataFrame([("t", "e", "d", "r", "enc")], "task_id string, entry_point string, decoder_input string, raw_output string, enc string")
    b = C.from_bottleneck(t, "enc", model=F.lit("m")).first()
    assert b.provenance.source == "bottleneck" and b.provenance.extra == {"encode_model": "enc"} and b.provenance.occurrence_count == 1
    f = C.fresh_stub(t, F.col("decoder_input"), F.col("raw_output"), F.lit("run-1"), F.lit("demo/model"), F.lit("p")).first()
    assert (f.run_id, f.provenance.source, f.provenance.model) == ("run-1", "fresh_stub", "demo/model")
    jobs = C.envelopes(C.from_bottleneck(t), F.lit("r"), "eval", F.lit(0))
    assert C.opened(jobs, ATTEMPTS).first().sample_id == f.sample_id
    with pytest.raises(Exception, match="no attempt"):
        C.opened(jobs.withColumn("payload", F.lit("{}")), ATTEMPTS).collect()


def test_the_summary_lists_all_missing_ids(spark, tmp_path):
    """In their order and as they are, however few are given back; and none where all have outcomes."""
    from evalmill.operators import outcomes as O
    from evalmill.sources.sinks import export_analysis

    ids = [f'é"{k}\\\n' if k % 9 == 0 else f"s{k}" for k in range(50)]
    attempts = spark.createDataFrame([(k, i, None, "t", "f", "text", "text", "pool", "m", 1) for k, i in enumerate(ids)], "pos long, sample_id string, run_id string, task_id string, entry_point string, decoder_input string, raw_output string, provenance_source string, provenance_model string, provenance_occurrence_count int")
    parse = attempts.select("pos", "sample_id", "run_id", F.lit(True).alias("parse_success"), F.lit(None).cast("string").alias("skip_reason"))
    test = attempts.where("pos % 5 = 0").select("pos", "sample_id", "run_id", F.lit("skipped").alias("outcome_kind"), F.lit(False).alias("tests_ran"), F.lit(None).cast("boolean").alias("all_tests_passed"), F.lit(None).cast("double").alias("test_pass_rate"), F.lit(True).alias("skipped"), F.lit("x").alias("skip_reason"))
    rows = O.with_quartile(O.enriched(attempts, parse, test, zstd=F.lit(1).cast("long")))
    given = export_analysis(rows.repartition(3), str(tmp_path / "a"), listed=3)
    told = json.loads((tmp_path / "a/summary.json").read_text())
    assert told["join_failures"] == {"missing_parse_count": 0, "missing_parse_sample_ids": [], "missing_test_count": 40, "missing_test_sample_ids": [i for k, i in enumerate(ids) if k % 5]}
    assert given["join_failures"]["missing_test_sample_ids"] == ids[1:4] and {k: v for k, v in given.items() if k != "join_failures"} == {k: v for k, v in told.items() if k != "join_failures"}
    export_analysis(rows.where("has_test_outcome"), str(tmp_path / "a"))
    assert json.loads((tmp_path / "a/summary.json").read_text())["join_failures"]["missing_test_sample_ids"] == []
