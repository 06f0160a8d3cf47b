import json
import os

import pytest

from evalmill import cli
from evalmill.functions.display import pretty, proof_summary, run_text, sweep_table, test_line, worker_table
from evalmill.operators.events import start_order
from evalmill.streaming.runs import new_run_id, plain_path

CHECK = "def check(candidate):\n    inputs = [[1, 2]]\n    results = [3]\n"


def test_import_to_analysis(spark, tmp_path, capsys):
    tasks = [{"task_id": "HumanEval/0", "entry_point": "add", "prompt": "add", "canonical_solution": "", "test": CHECK}]
    (tmp_path / "tasks.json").write_text(json.dumps(tasks))
    rows = [{"out": "def add(a, b):\n    return a + b\n", "count": 3}, {"out": "def add(a, b):\n    return a\n", "count": 1}, {"out": "prose", "count": 5}]
    (tmp_path / "human_eval-0-decode-dedup.jsonl").write_text("\n".join(map(json.dumps, rows)))
    at = lambda n: str(tmp_path / n)
    cli.main(["import-pool", "--source", at("human_eval-0-decode-dedup.jsonl"), "--tasks", at("tasks.json"), "--out", at("a.jsonl")])
    assert "3 attempts (9 weighted), 1 tasks" in capsys.readouterr().out
    cli.main(["parse", "--attempts", at("a.jsonl"), "--out", at("p.jsonl")])
    assert "parsed 3, 2 with code" in capsys.readouterr().out
    cli.main(["test", "--attempts", at("a.jsonl"), "--parse", at("p.jsonl"), "--tasks", at("tasks.json"), "--out", at("t.jsonl"), "--timeout", "10"])
    assert json.loads(capsys.readouterr().out)["pass_count"] == 1
    cli.main(["analyse", "--attempts", at("a.jsonl"), "--parse", at("p.jsonl"), "--test", at("t.jsonl"), "--out", at("out")])
    assert json.loads(capsys.readouterr().out)["correctness_pass_rate"] == 0.5
    assert (tmp_path / "out/summary.json").exists()
    cli.main(["outcomes", "--bundle", at("out")])
    kinds = {r["outcome_kind"]: r for r in map(json.loads, capsys.readouterr().out.splitlines())}
    assert kinds["tested"] == {"outcome_kind": "tested", "row_count": 2, "weighted_count": 4, "passed": 1, "samples": 2} and kinds["skipped"]["passed"] == 0
    cli.main(["outcomes", "--bundle", at("nowhere")])
    assert capsys.readouterr().out.strip() == ""
    cli.main(["run", "--root", str(tmp_path), "--run_id", "r1", "--attempts", at("a.jsonl"), "--tasks", at("tasks.json"), "--timeout", "10"])
    status = json.loads(capsys.readouterr().out)
    assert status == {"expected_jobs": 3, "terminals": 3, "kinds": {"tested": 2, "skipped": 1}, "stages": {"parse": 3, "test": 3}, "active_workers": 0, "active_concurrency": 0}
    step = lambda name, *more: (cli.main(["run", "--root", str(tmp_path), "--run_id", "r1", "--step", name, *more]), capsys.readouterr().out)[1]
    assert ": parse, " in step("workers") and ": parse, " not in (mine := step("workers", "--stage", "test")) and "stopped" in mine
    assert step("vacuum").strip() == "0 folders deleted"
    assert json.loads(step("wait", "--wait", "5"))["terminals"] == 3 and "3 jobs" in step("show")
    assert "proof_report" in step("export", "--out", at("bundle")) and json.loads((tmp_path / "bundle/proof_report.json").read_text())["complete"]
    assert step("stop").strip() == "no workers" and step("preflight").strip() == "ready"
    (tmp_path / "p.yaml").write_text("profiles:\n  p:\n    model: m\n")
    cli.main(["generate", "--tasks", at("tasks.json"), "--file", at("p.yaml"), "--id", "p", "--out", at("stub.jsonl")])
    assert "wrote 1 attempts" in capsys.readouterr().out
    both = [json.loads(x) for f in ("a.jsonl", "stub.jsonl") for part in sorted((tmp_path / f).glob("*.json")) for x in part.read_text().splitlines()]
    (tmp_path / "both.jsonl").write_text("\n".join(map(json.dumps, both)))
    cli.main(["spot-check", "--attempts", at("both.jsonl"), "--task", "HumanEval/0"])
    assert "fresh_stub: sample" in (out := capsys.readouterr().out) and "pool: sample" in out
    with pytest.raises(ValueError, match="no fresh_stub attempt"):
        cli.main(["spot-check", "--attempts", at("a.jsonl"), "--task", "HumanEval/0"])
    cli.main(["tune", "--attempts", at("a.jsonl"), "--parse", at("p.jsonl"), "--tasks", at("tasks.json"), "--timeout", "10", "--start", "1", "--most", "1", "--least", "1", "--out", at("sweep.json")])
    assert "best: 1 workers" in capsys.readouterr().out and json.loads((tmp_path / "sweep.json").read_text())["steps"][0]["reliable"]
    with pytest.raises(SystemExit, match="no handlers"):
        step("preflight", "--handlers", "no_such_module")
    with pytest.raises(SystemExit, match="cannot write"):
        cli.main(["run", "--root", at("tasks.json"), "--run_id", "r", "--step", "preflight"])
    cli.main(["run", "--root", str(tmp_path), "--run_id", "r2", "--step", "init"])
    assert step("init") and json.loads(capsys.readouterr().out or "{}") in ({}, status)
    for name, more in (("init", []), ("seed", ["--attempts", at("a.jsonl")]), ("start", ["--stage", "parse", "--tasks", at("tasks.json"), "--timeout", "10"])):
        cli.main(["run", "--root", str(tmp_path), "--run_id", "r3", "--step", name, *more])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["stages"] == {"parse": 3}
    cli.main(["tune", "--root", str(tmp_path), "--run_id", "r3", "--tasks", at("tasks.json"), "--timeout", "10", "--start", "1", "--most", "1", "--least", "1", "--measure", "20", "--warm_up", "0"])
    assert "best: 1 workers" in capsys.readouterr().out
    cli.main(["run", "--root", str(tmp_path), "--run_id", "r3", "--step", "status"])
    assert json.loads(capsys.readouterr().out)["terminals"] == 3
    with pytest.raises(SystemExit, match="no such path"):
        cli.main(["parse", "--attempts", at("none.jsonl"), "--out", at("x")])


def test_texts():
    report = {"run_id": "r", "terminal_count": 1, "expected_jobs": 2, "complete": False, "wall_seconds": 3.0, "throughput": {"overall_samples_per_second": 0.3, "by_stage": {"parse": 2.0}}, "outcomes": {"parse_success_count": 1, "tests_ran_count": 1, "all_tests_passed_count": 0, "missing_test_count": 1, "outcome_kind_counts": {"tested": 1}}}
    assert "1 of 2 jobs (not complete)" in proof_summary(report) 
    steps = [{"workers": w, "swapped": w > 2, "terminals_before": 0, "terminals_after": 9, "samples_per_second": 1.0 * w, "reliable": True} for w in (2, 4)]
    assert "best: 4" in sweep_table({"steps": steps, "best_workers": 4, "best_samples_per_second": 4.0, "stop_reason": "x"})
    assert pretty({"b": 1, "a": [2]}) == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}' and test_line({"sample_id": "s", "outcome_kind": "tested", "test_pass_rate": 0.5}) == "s: tested, 0.50 passed"
    assert "not seeded" in run_text({"run_id": "r", "init": {}, "seed": None}) and worker_table([]) == "no workers"
    assert plain_path("~/x/../y") == os.path.realpath(os.path.expanduser("~/y")) and plain_path("hdfs://a/b") == "hdfs://a/b" and plain_path(None) is None
    assert len(new_run_id("p")) == 10 and start_order(["parse", "test"]) == ["test", "parse"]
