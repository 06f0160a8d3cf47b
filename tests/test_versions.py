"""Claims and versioned tables: several processes at once, writers broken off at each step, readers that never write."""

import os
import subprocess
import sys
import textwrap
import threading

import pytest

from evalmill.sources import versions as V

SCHEMA = "run_id string, sample_id string, outcome_kind string, pos long"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(frame):
    return {(r.run_id, r.sample_id, r.outcome_kind) for r in frame.collect()} if frame is not None else None


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*"))


def test_one_of_many_claims(spark, tmp_path):
    won = []
    go = threading.Barrier(8)

    def one(k):
        go.wait()
        if V.claim(spark, f"{tmp_path}/a/claim", {"by": k}):
            won.append(k)

    several = [threading.Thread(target=one, args=(k,)) for k in range(8)]
    for t in several:
        t.start()
    for t in several:
        t.join()
    assert len(won) == 1 and V.claimed(spark, f"{tmp_path}/a/claim") == {"by": won[0]}
    assert V.names(spark, f"{tmp_path}/a") == ["claim"] and len(V.names(spark, f"{tmp_path}/a/claim")) == 1 and not [f for f in os.listdir(tmp_path / "a") if f.startswith(".new")]
    assert V.claimed(spark, f"{tmp_path}/none") is None and V.names(spark, f"{tmp_path}/none") == []


def test_upserts(spark, tmp_path):
    t = V.Table(spark, str(tmp_path / "t"))
    assert t.read() is None and t.version() == 0
    t.upsert(spark.createDataFrame([("r1", "a", "tested", 0), ("r1", "c", "tested", 0), ("r2", "a", "tested", 0)], SCHEMA))
    second = spark.createDataFrame([("r1", "a", "skipped", 1), ("r1", "b", "tested", 1), ("r1", "c", "late", -1)], SCHEMA)
    want = {("r1", "a", "skipped"), ("r1", "b", "tested"), ("r1", "c", "tested"), ("r2", "a", "tested")}
    assert t.upsert(second) == 2 and rows(t.read()) == want
    assert t.upsert(second) == 3 and rows(t.read()) == want
    t.upsert(spark.createDataFrame([("r1", "b", "again", 1)], SCHEMA))  # of equals the new one
    assert rows(t.read()) == want - {("r1", "b", "tested")} | {("r1", "b", "again")} and rows(t.read(2)) == want
    assert t.upsert(spark.createDataFrame([], SCHEMA)) == 5 and t.read().count() == 4


def test_parts_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "FAN", 3)
    t, want = V.Table(spark, str(tmp_path / "t")), {}
    for k in range(11):
        want |= {("r", f"s{k % 4}"): f"k{k}", ("r", f"t{k}"): "x"}
        t.upsert(spark.createDataFrame([("r", f"s{k % 4}", f"k{k}", k), ("r", f"t{k}", "x", k)], SCHEMA))
    assert {(r.run_id, r.sample_id): r.outcome_kind for r in t.read().collect()} == want
    assert [p["level"] for p in t.parts()] == [2, 0, 0]
    before = rows(t.read())
    assert t.vacuum() == 0 and t.vacuum(-10) > 8 and rows(t.read()) == before and len(V.names(spark, t.path + "/data")) == 3


@pytest.mark.parametrize("step", ["_written", "_put", "_merge", "write_document", "moved"])
def test_a_writer_broken_off_at_each_step(spark, tmp_path, monkeypatch, step):
    """Before and within each step: the state is that before the commit or that after it, and the next writer goes on."""
    t = V.Table(spark, str(tmp_path / "t"))
    t.upsert(spark.createDataFrame([("r", "a", "old", 0)], SCHEMA))
    new = spark.createDataFrame([("r", "a", "new", 1), ("r", "b", "new", 1)], SCHEMA)
    before, after = {("r", "a", "old")}, {("r", "a", "new"), ("r", "b", "new")}
    for late in (False, True):
        with monkeypatch.context() as m:
            on = V.Table if hasattr(V.Table, step) else V
            real = getattr(on, step)

            def stop(*a, real=real, late=late, **k):
                if late:
                    real(*a, **k)
                raise KeyboardInterrupt

            m.setattr(on, step, stop)
            with pytest.raises(KeyboardInterrupt):
                t.upsert(new)
        assert rows(t.read()) in (before, after)
        there = files(tmp_path)
        assert rows(V.Table(spark, t.path).read()) in (before, after) and t.version() in (1, 2, 3)
        assert files(tmp_path) == there  # reading leaves everything as it is
    t.upsert(new)
    assert rows(t.read()) == after


WRITER = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from evalmill.sources.versions import Table
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
t = Table(spark, {path!r})
for k in range(6):
    # in every commit all rows of a writer say the same
    t.upsert(spark.createDataFrame([("r", f"{{sys.argv[1]}}-{{i}}", str(k), k) for i in range(5)], {schema!r}))
"""


def test_readers_and_writers_of_several_processes(spark, tmp_path):
    """Two writers in processes of their own, a reader here: every state read has whole commits only, and none is lost."""
    path = str(tmp_path / "t")
    (tmp_path / "w.py").write_text(textwrap.dedent(WRITER.format(root=ROOT, path=path, schema=SCHEMA)))
    writers = [subprocess.Popen([sys.executable, str(tmp_path / "w.py"), name], stderr=subprocess.DEVNULL) for name in "xy"]
    t, seen = V.Table(spark, path), 0
    while any(w.poll() is None for w in writers):
        version = t.version()
        for r in t.read(version).groupBy("run_id").pivot("sample_id").agg({"outcome_kind": "max"}).collect() if version else []:
            found = {k: v for k, v in r.asDict().items() if "-" in k}
            for name in "xy":
                own = {v for k, v in found.items() if k.startswith(name)}
                assert len(own) <= 1 and sum(k.startswith(name) for k in found) in (0, 5), found
            seen += 1
    assert [w.wait() for w in writers] == [0, 0] and seen and t.version() >= 12
    assert rows(t.read()) == {("r", f"{n}-{i}", "5") for n in "xy" for i in range(5)}
