import pytest
from pyspark.sql import functions as F

from evalmill.functions import sandbox as X
from evalmill.functions.extract import extract, parse_attempts
from evalmill.functions.columns import outcome_banner
from evalmill.plans.jobs import analyse, test_attempts
from evalmill.schemas import ATTEMPTS, TASKS

test_attempts.__test__ = False
ADD = "def add(a, b):\n    return a + b\n"
CHECK = "def check(candidate):\n    inputs = [[1, 2], [3, 4]]\n    results = [3, 7]\n    for i, r in zip(inputs, results):\n        assert candidate(*i) == r\n"


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("```python\ndef f():\n    return 1\n```", "def f():\n    return 1"),
        ("Here you go:\n\ndef f():\n    return 1\n\nHope this helps!", "def f():\n    return 1"),
        ("```\ndef f():\n    return 1", "def f():\n    return 1"),
        ("    def f():\n        return 1\n", "def f():\n    return 1"),
        ("def f(x):\n    return (x", "def f(x):\n    return (x)"),
        ("no code here", None),
        ("", None),
    ],
)
def test_extraction(text, code):
    out = extract(text)
    assert out["parse_success"] == (code is not None) and (out["extracted_code"] or "").strip() == (code or "").strip()
    assert out["candidate_count"] >= out["valid_count"] and (out["code_eval"] is None) == (code is None)


def test_a_broken_extractor_is_an_outcome(spark):
    def broken(text):
        raise RuntimeError("boom")

    a = spark.createDataFrame([("s", None, "t", "x")], "sample_id string, run_id string, task_id string, raw_output string")
    assert parse_attempts(a, broken).first().skip_reason == "parse_handler_error: RuntimeError: boom"
    assert parse_attempts(a).first().skip_reason == "no_valid_candidate"


def run(code, cases, timeout=10.0, entry="add"):
    return X.execute(code, entry, [(repr(a), repr(b)) for a, b in cases], timeout)


def test_success_and_noise():
    out = run("print('noise')\n" + ADD, [((1, 2), 3)])
    assert (out["outcome_kind"], out["test_pass_rate"], out["all_tests_passed"]) == ("tested", 1.0, True)


def test_syntax_error_is_tested():
    out = run("def nope(:", [((1, 2), 3)])
    assert out["outcome_kind"] == "tested" and out["test_pass_rate"] == 0.0 and out["test_case_results"][0]["compile_success"] is False


def test_state_lives_within_a_sample():
    code = "n = 0\ndef add(*a):\n    global n\n    n += 1\n    return n\n"
    assert run(code, [((), 1), ((), 2)])["all_tests_passed"] and run(code, [((), 1)])["all_tests_passed"]


def test_timeout():
    out = run("def add(a, b):\n    while True: pass\n", [((1, 2), 3)], 0.5)
    assert out["infra_error"] == {"stage": "worker_timeout", "execution_mode": "local_fork_worker", "detail": "worker timed out after 0.5s"}


def test_other_outcomes():
    assert "not found" in run("x = 1", [((1, 2), 3)])["test_case_results"][0]["error"]
    assert run("def add(a, b):\n    raise ValueError('worker exited')\n", [((1, 2), 3)] * 2)["infra_error"]["stage"] == "heuristic_reclassification"
    assert run("import os\ndef add(a, b):\n    os._exit(3)\n", [((1, 2), 3)])["infra_error"]["stage"] == "worker_nonzero_exit"
    assert run(ADD, [])["outcome_kind"] == "internal_error"
    assert run("def add(a, b):\n    return a / b * 3\n", [((1, 3), 1.0 + 1e-12)])["all_tests_passed"]
    assert not run("def add(a, b):\n    return [a, b]\n", [((1, 2), (1, 2))])["all_tests_passed"]
    assert run("def add(a, b):\n    return {1}\n", [((1, 2), {1})])["test_pass_rate"] == 0.0


def test_suites():
    assert X.read_suite(CHECK) == ("inputs_results", [[1, 2], [3, 4]], [3, 7])
    assert X.read_suite("def check(c):\n    inputs = [1]\n")[0] == "inputs_ref_func"
    for source, error in (("x = 1", ValueError), ("def check(c):\n    results = []\n", ValueError), ("def check(c):\n    inputs = 3\n", TypeError)):
        with pytest.raises(error):
            X.read_suite(source)
    with pytest.raises(ValueError):
        X.cases_of("def check(c):\n    inputs = [1]\n    results = [1, 2]\n")


@pytest.fixture
def tasks(spark):
    return spark.createDataFrame([("t1", "add", "p", "s", CHECK), ("t2", "add", "p", "s", "def check(c):\n    inputs = [1]\n")], TASKS)


def attempts_of(spark, *texts):
    made = [(f"s{i}", None, t, "add", "describe", x, ("pool", None, None, None, None, None, 2, None, {})) for i, (t, x) in enumerate(texts)]
    return spark.createDataFrame(made, ATTEMPTS).withColumn("pos", F.monotonically_increasing_id())


def test_whole_chain_and_analysis(spark, tasks, tmp_path):
    a = attempts_of(spark, ("t1", f"```python\n{ADD}```"), ("t1", ADD.replace("+", "-")), ("t1", "nothing"), ("t2", ADD), ("t9", ADD))
    p = parse_attempts(a).persist()
    t = test_attempts(a, p, tasks, 10.0).persist()
    got = {r.sample_id: r for r in t.withColumn("banner", outcome_banner()).collect()}
    assert [got[f"s{i}"].banner for i in range(5)] == ["[ALL TESTS PASSED]", "[TEST FAIL: 0/2 passed]", "[SKIPPED: no_valid_candidate]", "[SKIPPED: unsupported_test_shape]", "[INTERNAL ERROR: unknown task: t9]"]
    assert got["s0"].test_case_results[0].actual_output == "3"
    from evalmill.functions.columns import flattened

    summary = analyse(flattened(a).drop("provenance_extra_json"), p.withColumn("pos", F.lit(0)), t.withColumn("pos", F.lit(0)), str(tmp_path / "out"))
    assert summary["attempt_count"] == 5 and summary["correctness_pass_rate"] == 0.5 and summary["outcome_kind_counts"] == {"tested": 2, "skipped": 2, "internal_error": 1}
    assert spark.read.parquet(str(tmp_path / "out/aggregates/by_task.parquet")).count() == 3


def test_literals_travel_as_they_are_written(spark):
    source = "def check(candidate):\n    inputs = [[1e999], [-1e999, 'a'],\n        [(1,\n          2)]]\n    results = [1e999, {1: {2}}, None]\n"
    t = spark.createDataFrame([("t", source)], "task_id string, test string")
    cases = X.task_cases(t).first().cases
    assert [tuple(c) for c in cases] == [("[1e309]", "1e309"), ("[-1e309, 'a']", "{1: {2}}"), ("[(1, 2)]", "None")]
    out = X.execute("def f(x, *rest):\n    return x\n", "f", [tuple(c) for c in cases[:1]], 10.0)
    assert out["outcome_kind"] == "tested" and out["all_tests_passed"]


def test_long_answers_are_cut_off_while_they_are_read(monkeypatch):
    monkeypatch.setattr(X, "ANSWER_BYTES", 1 << 20)
    out = run("def add(a, b):\n    return 'x' * (3 << 20)\n", [((1, 2), 3)])
    assert out["infra_error"]["stage"] == "worker_payload_too_large"


def test_candidates_run_where_the_package_is_an_archive(tmp_path):
    """As on machines that lack it, to which it is sent as a zip."""
    import os
    import subprocess
    import sys
    import zipfile

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(X.__file__))))
    with zipfile.ZipFile(tmp_path / "code.zip", "w") as z:
        for top, _, names in os.walk(os.path.join(root, "evalmill")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), root))
    program = f"import evalmill.functions.sandbox as X\nprint('code.zip' in X.__file__, X.execute({ADD!r}, 'add', [('(1, 2)', '3')], 10.0)['outcome_kind'])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path / "code.zip")}
    said = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == ["True", "tested"], said


def test_long_noisy_tails():
    tail = "\n".join(f"x{i} is not ( code" if i % 2 else f"y{i} = {i}" for i in range(300))
    assert extract("def f():\n    return 1\n" + tail)["extracted_code"].startswith("def f():\n    return 1")


def test_contradictory_outcomes_are_errors(spark):
    from evalmill.schemas import TEST_OUTCOMES, cast_to, checked_outcomes

    rows = spark.createDataFrame([("s", "tested", None), ("s", "skipped", 0.5), ("s", "infra_error", None), ("s", "odd", None)], "sample_id string, outcome_kind string, test_pass_rate double")
    for r in rows.collect():
        with pytest.raises(Exception, match="contradictory outcome of sample s"):
            checked_outcomes(cast_to(rows.where(F.col("outcome_kind") == r.outcome_kind), TEST_OUTCOMES)).collect()


def test_a_batch_in_frames_goes_on_where_it_was(spark, tasks, tmp_path, monkeypatch):
    """What broke off is run again, what was committed isn't: each program leaves a mark when it runs."""
    from evalmill.plans import jobs
    from evalmill.sources.versions import Table

    marks = tmp_path / "marks"
    marks.mkdir()
    program = lambda k: f"import tempfile, os\nopen({str(marks)!r} + '/{k}-' + str(os.getpid()), 'w').close()\n{ADD}"
    a = attempts_of(spark, *(("t1", program(k)) for k in range(6)), ("t1", "nothing"))
    a = a.unionByName(a.where("sample_id = 's0'").withColumn("pos", F.lit(10**12)))  # a sample that repeats
    p, table = parse_attempts(a.where(F.col("pos") < 10**12)).persist(), Table(spark, str(tmp_path / "t"), ("sample_id",))
    real, calls = jobs.test_attempts, []

    def breaks(*args):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return real(*args)

    monkeypatch.setattr(jobs, "test_attempts", breaks)
    with pytest.raises(KeyboardInterrupt):
        jobs.test_in_frames(a, p, tasks, table, 10.0, frame=2)
    assert table.read().count() == 4
    out = jobs.test_in_frames(a, p, tasks, table, 10.0, frame=2)
    assert len(calls) == 5 and sorted((r.sample_id, r.outcome_kind) for r in out.collect()) == [(f"s{k}", "tested") for k in range(6)] + [("s6", "skipped")]
    ran = [f.name.partition("-")[0] for f in marks.iterdir()]
    assert sorted(ran) == [str(k) for k in range(6)]
    assert jobs.test_in_frames(a, p, tasks, table, 10.0).count() == 7 and len(calls) == 5  # nothing is left


def test_a_batch_in_frames_stops_at_an_internal_error(spark, tasks, tmp_path):
    from evalmill.plans.jobs import test_in_frames
    from evalmill.sources.versions import Table

    a = attempts_of(spark, ("t1", ADD), ("t9", ADD), ("t1", ADD), ("t1", ADD))
    p = parse_attempts(a).persist()
    out = test_in_frames(a, p, tasks, Table(spark, str(tmp_path / "t"), ("sample_id",)), 10.0, frame=1, fail_fast=True)
    assert [(r.sample_id, r.outcome_kind) for r in out.orderBy("sample_id").collect()] == [("s0", "tested"), ("s1", "internal_error")]
    assert test_in_frames(a.limit(0), p, tasks, Table(spark, str(tmp_path / "none"), ("sample_id",))).count() == 0


def test_a_candidate_that_ends_what_started_it_harms_no_other_sample(spark):
    cases = [{"input_value": "1", "expected_output": "2"}]
    codes = ["def f(x):\n    return x + 1\n"] * 6 + ["import os\nos.kill(os.getppid(), 9)\n"] * 2 + ["import json\njson.mark = 1\ndef f(x):\n    return x + 1\n", "import json\ndef f(x):\n    return x + 1 + hasattr(json, 'mark')\n"] * 3
    rows = spark.createDataFrame([(f"s{k:02d}", "f", c, cases) for k, c in enumerate(codes)], "sample_id string, entry_point string, extracted_code string, cases array<struct<input_value:string,expected_output:string>>")
    out = {r.sample_id: r for r in X.run_tests(rows, 10.0, 1).collect()}
    assert [out[f"s{k:02d}"].outcome_kind for k in range(14)] == ["tested"] * 6 + ["infra_error"] * 2 + ["tested"] * 6
    assert all(out[f"s{k:02d}"].all_tests_passed for k in range(14) if k not in (6, 7))


def test_frames_and_streams_are_dealt_to_all_cores(spark, tasks, tmp_path, monkeypatch):
    """Small batches too: adaptive execution would put them into a few tasks."""
    import evalmill.plans.jobs as jobs
    import evalmill.streaming.runs as runs
    from evalmill.sources.versions import Table

    a, dealt, real = attempts_of(spark, ("t1", ADD), ("t1", ADD)), [], jobs.test_attempts

    def seen(attempts, parse, tasks, timeout=None, parallel=None):
        dealt.append(parallel)
        return real(attempts, parse, tasks, timeout, parallel)

    monkeypatch.setattr(jobs, "test_attempts", seen)
    monkeypatch.setattr(runs, "test_attempts", seen)
    p = parse_attempts(a).persist()
    assert jobs.test_in_frames(a, p, tasks, Table(spark, str(tmp_path / "t"), ("sample_id",)), 10.0).count() == 2
    assert runs.test_stage(a, {"parse": p}, {"tasks": tasks, "timeout": 10.0}).count() == 2
    runs.test_stage(a, {"parse": p}, {"tasks": tasks, "timeout": 10.0, "concurrency": 3})
    n = spark.sparkContext.defaultParallelism
    assert dealt == [n, n, 3]
