"""Running candidates against their cases, each sample in a process of its own with limits."""

from __future__ import annotations

import ast
import json
import os
import pkgutil
import select
import socket
import subprocess
import sys
import tempfile
import time
import traceback
from collections.abc import Iterator
from functools import cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cases import INFRA_MARKERS

TIMEOUT_SECONDS, ANSWER_BYTES = 30.0, 16 << 20
#: Samples that a task runs before it passes their outcomes on, and samples to a task.
FRAME_SAMPLES, TASK_SAMPLES = 32, 256
#: Fixed value: the name of this way of execution. Names of error stages below are fixed values too.
MODE = "local_fork_worker"
#: Fixed value: the environment of a candidate.
ENVIRONMENT = {"HOME": "/tmp", "LANG": "C.UTF-8", "PATH": "/usr/bin:/bin:/usr/sbin:/sbin", "PYTHONHASHSEED": "0"}
_CASE = "input_value:string,expected_output:string,actual_output:string,passed:boolean,error:string,compile_success:boolean,compile_error:string"
TESTED = f"sample_id string, outcome_kind string, tests_ran boolean, test_pass_rate double, all_tests_passed boolean, test_case_results array<struct<{_CASE}>>, infra_error struct<stage:string,execution_mode:string,detail:string>, internal_error string, latency_ms double"
CASES = "shape string, cases array<struct<input_value:string,expected_output:string>>, problem string"


class InfraError(Exception):
    def __init__(self, stage: str, detail: str):
        super().__init__(detail)
        self.stage = stage


def timeout_seconds() -> float:
    """EVALMILL_TIMEOUT_SECONDS, or the default."""
    return float(os.environ.get("EVALMILL_TIMEOUT_SECONDS") or TIMEOUT_SECONDS)


def _literal_list(body: list[ast.stmt], name: str) -> list | None:
    for node in body:
        target = node.targets[0] if isinstance(node, ast.Assign) and len(node.targets) == 1 else node.target if isinstance(node, ast.AnnAssign) and node.value else None
        if isinstance(target, ast.Name) and target.id == name:
            value = ast.literal_eval(node.value)
            if not isinstance(value, list):
                raise TypeError(f"{name} is not a list")
            return value
    return None


def read_suite(source: str) -> tuple[str, list, list | None]:
    """Shape, inputs and results of a test source: the list literals at the top of its check function."""
    check = next((n for n in ast.parse(source).body if isinstance(n, ast.FunctionDef) and n.name == "check"), None)
    if check is None:
        raise ValueError("no check function")
    inputs = _literal_list(check.body, "inputs")
    if inputs is None:
        raise ValueError("check has no inputs")
    results = _literal_list(check.body, "results")
    return ("inputs_ref_func" if results is None else "inputs_results"), inputs, results


def cases_of(source: str) -> list[tuple[Any, Any]]:
    shape, inputs, results = read_suite(source)
    if shape != "inputs_results":
        raise ValueError("unsupported_test_shape")
    return list(zip(inputs, results, strict=True))


def literals(source: str, name: str) -> list[str]:
    """The elements of a list literal of the check function, as they are written: some values, like an infinite float, have no literal of their own."""
    check = next(n for n in ast.parse(source).body if isinstance(n, ast.FunctionDef) and n.name == "check")
    for node in check.body:
        target = node.targets[0] if isinstance(node, ast.Assign) and len(node.targets) == 1 else node.target if isinstance(node, ast.AnnAssign) and node.value else None
        if isinstance(target, ast.Name) and target.id == name:
            return [ast.unparse(e) for e in node.value.elts]
    return []


def task_cases(tasks: DataFrame) -> DataFrame:
    """tasks with shape, cases (Python literals) and problem: each task is parsed once, not once per sample."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for test in frame["test"]:
                try:
                    shape, inputs, results = read_suite(test or "")
                    if results is not None and len(inputs) != len(results):
                        raise ValueError("inputs and results differ in length")
                    pairs = zip(literals(test, "inputs"), literals(test, "results")) if results is not None else ()
                    out.append((shape, [{"input_value": a, "expected_output": b} for a, b in pairs], None))
                except Exception as e:
                    out.append((None, [], f"{type(e).__name__}: {e}"))
            yield frame.assign(shape=[x[0] for x in out], cases=[x[1] for x in out], problem=[x[2] for x in out])

    return tasks.mapInPandas(f, f"{', '.join(f'{c} {k}' for c, k in tasks.dtypes)}, {CASES}")


@cache
def runner_source() -> str:
    """The child's program as text: where the package was sent as an archive, it is no file that an interpreter could open."""
    return pkgutil.get_data(__package__, "runner.py").decode()


class Starter:
    """A fresh interpreter that forks a process for each sample, as starting and importing costs some twenty times a fork. It runs no candidate itself, so a sample's process has
    nothing of other samples; if a candidate ends it, the next sample has a new one."""

    def __init__(self):
        self.process, self.line, self.said = None, None, b""

    def __enter__(self) -> Starter:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        if self.process is not None:
            self.line.close()
            self.process.kill()
            self.process.wait()
        self.process, self.said = None, b""

    def start(self, home: str, timeout: float) -> Child:
        if self.process is None:
            self.line, its = socket.socketpair()
            with its:
                self.process = subprocess.Popen([sys.executable, "-I", "-S", "-c", runner_source(), str(its.fileno())], stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, cwd="/", env=ENVIRONMENT, pass_fds=[its.fileno()], start_new_session=True)
        (given, stdin), (stdout, taken) = os.pipe(), os.pipe()
        child = Child(self, open(stdin, "wb", 0), open(stdout, "rb", 0))
        try:
            socket.send_fds(self.line, [home.encode()], [given, taken])
            pid = self.hear(timeout)
            if pid is None or not pid.isdigit():
                raise OSError(pid.decode() if pid else "the starter of processes has ended")
        except (OSError, subprocess.TimeoutExpired):
            child.close()
            self.close()
            raise
        finally:
            os.close(given)
            os.close(taken)
        child.pid = int(pid)
        return child

    def hear(self, timeout: float) -> bytes | None:
        """The next line; None if it has ended. TimeoutExpired if there is none in time."""
        end = time.monotonic() + timeout
        while b"\n" not in self.said:
            if not select.select([self.line], [], [], max(0.0, end - time.monotonic()))[0]:
                raise subprocess.TimeoutExpired("starter", timeout)
            try:
                data = self.line.recv(1 << 12)
            except ConnectionError:
                data = b""
            if not data:
                return None
            self.said += data
        found, _, self.said = self.said.partition(b"\n")
        return found


class Child:
    """A sample's process."""

    def __init__(self, starter: Starter, stdin: Any, stdout: Any):
        self.starter, self.stdin, self.stdout, self.pid, self.returncode = starter, stdin, stdout, 0, None

    def wait(self, timeout: float) -> None:
        if self.returncode is None:
            said = self.starter.hear(timeout)
            self.returncode = -9 if said is None else int(said)

    def close(self) -> None:
        self.stdin.close()
        self.stdout.close()


def run_cases(code: str, entry_point: str, cases: list[tuple[str, str]], timeout: float, starter: Starter | None = None) -> list[dict]:
    """Case results, from a process of their own; cases are Python literals."""
    if not cases:
        return []
    if starter is None:
        with Starter() as own:
            return run_cases(code, entry_point, cases, timeout, own)
    request = json.dumps({"code": code, "entry_point": entry_point, "cases": cases, "timeout": timeout}).encode()
    with tempfile.TemporaryDirectory() as home:
        try:
            child = starter.start(home, timeout)
        except subprocess.TimeoutExpired as e:
            raise InfraError("worker_timeout", f"worker timed out after {timeout}s") from e
        except OSError as e:
            raise InfraError("fork_failed", f"fork failed: {e}") from e
        try:
            answer = _answer(child, request, timeout)
        finally:
            _kill(child)
    if child.returncode:
        raise InfraError("worker_nonzero_exit", f"worker exited with rc={child.returncode}")
    try:
        payload = json.loads(answer)
    except ValueError as e:
        raise InfraError("worker_payload_parse", "invalid JSON from worker" if answer else "worker returned no output") from e
    if "error" in payload:
        raise InfraError("worker_payload_error", payload["error"])
    if len(payload["results"]) != len(cases):
        raise InfraError("worker_payload_mismatched_batch_count", f"{len(payload['results'])} results for {len(cases)} cases")
    return payload["results"]


def _answer(child: Child, request: bytes, timeout: float, most: int | None = None) -> bytes:
    """What the child writes until it closes its output: bounded while it is read, in time and size."""
    import selectors

    most = ANSWER_BYTES if most is None else most
    end, parts, size, sent = time.monotonic() + timeout, [], 0, 0
    with selectors.DefaultSelector() as wait:
        for pipe, kind in ((child.stdin, selectors.EVENT_WRITE), (child.stdout, selectors.EVENT_READ)):
            os.set_blocking(pipe.fileno(), False)
            wait.register(pipe, kind)
        while wait.get_map():
            ready = wait.select(max(0.0, end - time.monotonic()))
            if not ready and time.monotonic() >= end:
                raise InfraError("worker_timeout", f"worker timed out after {timeout}s")
            for key, _ in ready:
                if key.fileobj is child.stdin:
                    try:
                        sent += os.write(child.stdin.fileno(), request[sent : sent + (1 << 16)])
                    except BrokenPipeError:
                        sent = len(request)
                    if sent == len(request):
                        wait.unregister(child.stdin)
                        child.stdin.close()
                elif data := os.read(child.stdout.fileno(), 1 << 16):
                    parts.append(data)
                    size += len(data)
                    if size > most:
                        raise InfraError("worker_payload_too_large", f"worker wrote more than {most} bytes")
                else:
                    wait.unregister(child.stdout)
    try:
        child.wait(max(0.0, end - time.monotonic()))
    except subprocess.TimeoutExpired as e:
        raise InfraError("worker_timeout", f"worker timed out after {timeout}s") from e
    return b"".join(parts)


def _kill(child: Child) -> None:
    """The process and all it has started; and its starter, if that doesn't answer or has ended."""
    import signal

    try:
        os.killpg(child.pid, signal.SIGKILL)
    except ProcessLookupError:
        if child.returncode is None:  # it hasn't made its group yet
            try:
                os.kill(child.pid, signal.SIGKILL)
            except ProcessLookupError:
                pass
    child.close()
    try:
        child.wait(10.0)
    except subprocess.TimeoutExpired:
        child.returncode = -9
        child.starter.close()
    if child.starter.process is not None and child.starter.process.poll() is not None:
        child.starter.close()


def classify(results: list[dict]) -> str:
    said = [r["error"] or r["compile_error"] for r in results]
    broken = results and not any(r["passed"] for r in results) and all(said) and len(set(said)) == 1 and any(m in said[0].lower() for m in INFRA_MARKERS)
    return "infra_error" if broken else "tested"


def execute(code: str, entry_point: str, cases: list[tuple[str, str]], timeout: float | None = None, starter: Starter | None = None) -> dict:
    """The outcome of one sample; nothing that a candidate does raises here."""
    began = time.perf_counter()
    empty = {"outcome_kind": None, "tests_ran": False, "test_pass_rate": None, "all_tests_passed": None, "test_case_results": [], "infra_error": None, "internal_error": None}
    try:
        results = run_cases(code, entry_point, cases, timeout_seconds() if timeout is None else timeout, starter)
        if not results:
            out = empty | {"outcome_kind": "internal_error", "internal_error": "a tested sample needs case results"}
        elif classify(results) == "infra_error":
            out = empty | {"outcome_kind": "infra_error", "infra_error": {"stage": "heuristic_reclassification", "execution_mode": MODE, "detail": results[0]["error"] or results[0]["compile_error"]}}
        else:
            rate = sum(r["passed"] for r in results) / len(results)
            out = empty | {"outcome_kind": "tested", "tests_ran": True, "test_pass_rate": rate, "all_tests_passed": rate == 1.0, "test_case_results": results}
    except InfraError as e:
        out = empty | {"outcome_kind": "infra_error", "infra_error": {"stage": e.stage, "execution_mode": MODE, "detail": str(e)}}
    except Exception:
        out = empty | {"outcome_kind": "internal_error", "internal_error": traceback.format_exc()}
    return out | {"latency_ms": (time.perf_counter() - began) * 1000}


def run_tests(rows: DataFrame, timeout: float | None = None, parallel: int | None = None) -> DataFrame:
    """rows: sample_id, entry_point, extracted_code, cases. Outcomes of all; dealt evenly into small tasks, as one sample may take the whole timeout."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Starter() as starter:
            for frame in frames:
                for k in range(0, len(frame), FRAME_SAMPLES):
                    some = frame.iloc[k : k + FRAME_SAMPLES]
                    out = []
                    for sample, entry, code, cases in zip(some["sample_id"], some["entry_point"], some["extracted_code"], some["cases"]):
                        out.append({"sample_id": sample, **execute(code, entry, [(c["input_value"], c["expected_output"]) for c in cases], timeout, starter)})
                    yield pd.DataFrame(out)

    picked = rows.select("sample_id", "entry_point", "extracted_code", F.col("cases"))
    return (picked.repartition(parallel) if parallel else picked.repartition("sample_id")).mapInPandas(f, TESTED)


def tasks_for(samples: int, least: int) -> int:
    """How many tasks run so many samples."""
    return max(least, -(-samples // TASK_SAMPLES))
