"""The process that runs one candidate. It reads a request from stdin and writes one JSON answer to a kept copy of stdout.

It is forked by an interpreter that has started, imported what is needed here, and runs no candidate itself.
"""

import ast
import json
import math
import os
import resource
import socket
import sys


def limit(kind, value):
    try:
        resource.setrlimit(kind, (value, value))
        return True
    except (ValueError, OSError):
        return False


def close(a, b):
    if a is b:
        return True
    if type(a) in (int, float) and type(b) in (int, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=0.0)
    return bool(a == b)


def plain(value):
    try:
        json.dumps(value)
        return value
    except (TypeError, ValueError, RecursionError):
        return repr(value)


def failed(cases, error, compiled):
    return [{"input_value": i, "expected_output": e, "actual_output": None, "passed": False, "error": None if not compiled else error, "compile_success": compiled, "compile_error": None if compiled else error} for i, e in cases]


def said(e):
    return f"{type(e).__name__}: {e}"


def run(request):
    cases = [(ast.literal_eval(i), ast.literal_eval(e)) for i, e in request["cases"]]
    space = {"__name__": "candidate"}
    try:
        code = compile(request["code"], "<candidate>", "exec")
    except (SyntaxError, ValueError) as e:
        return failed(cases, said(e), False)
    try:
        exec(code, space)
    except BaseException as e:  # noqa: BLE001
        return failed(cases, said(e), True)
    name = request["entry_point"]
    f = space.get(name)
    if not callable(f):
        return failed(cases, f"Function '{name}' not found in executed code", True)
    out = []
    for given, expected in cases:
        try:
            got = plain(f(*given) if isinstance(given, (list, tuple)) else f(given))
            out.append({"input_value": given, "expected_output": expected, "actual_output": got, "passed": close(got, expected), "error": None, "compile_success": True, "compile_error": None})
        except BaseException as e:  # noqa: BLE001
            out += failed([(given, expected)], said(e), True)
    return out


def main():
    request = json.loads(sys.stdin.buffer.read())
    answer = os.fdopen(os.dup(1), "w")
    quiet = os.open(os.devnull, os.O_RDWR)
    for fd in (0, 1, 2):
        os.dup2(quiet, fd)
    seconds = max(1, math.ceil(request["timeout"]))
    for kind, value in ((resource.RLIMIT_CPU, seconds), (resource.RLIMIT_FSIZE, 10 << 20), (resource.RLIMIT_NOFILE, 64), (resource.RLIMIT_NPROC, 16)):
        limit(kind, value)
    if sys.platform != "darwin" and not limit(resource.RLIMIT_AS, 1 << 30):
        limit(resource.RLIMIT_DATA, 1 << 30)
    try:
        payload = {"results": [r | {k: json.dumps(plain(r[k])) for k in ("input_value", "expected_output", "actual_output")} for r in run(request)]}
    except BaseException as e:  # noqa: BLE001
        payload = {"error": said(e)}
    answer.write(json.dumps(payload))
    answer.flush()
    os._exit(0)


def serve(line):
    """A process for each message, which is its folder and comes with its stdin and stdout: says its number, and how it ended."""
    while True:
        folder, pipes, _, _ = socket.recv_fds(line, 1 << 16, 2)
        if not folder:
            os._exit(0)
        try:
            child = os.fork()
        except OSError as e:
            line.sendall(f"! {e}\n".encode())
            for fd in pipes:
                os.close(fd)
            continue
        if not child:
            os.setsid()
            line.close()
            os.chdir(folder)
            for to, fd in enumerate(pipes):
                os.dup2(fd, to)
                os.close(fd)
            main()
        for fd in pipes:
            os.close(fd)
        line.sendall(b"%d\n" % child)
        line.sendall(b"%d\n" % os.waitstatus_to_exitcode(os.waitpid(child, 0)[1]))


serve(socket.socket(fileno=int(sys.argv[1])))
