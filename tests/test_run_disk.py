"""What a run leaves and takes on disk."""

import hashlib
import os

from pyspark.sql import functions as F

from evalmill import staging
from evalmill.schemas import ATTEMPTS, TASKS
from evalmill.sources import versions as V
from evalmill.streaming.runs import Run

ADD = "```python\ndef add(a, b):\n    return a + b\n```\n"
CHECK = "def check(candidate):\n    inputs = [[1, 2]]\n    results = [3]\n"


def size(folder):
    return sum(os.path.getsize(os.path.join(top, n)) for top, _, names in os.walk(folder) for n in names)


def test_a_run_keeps_no_copies_of_texts(spark, tmp_path):
    texts = ["".join(hashlib.sha256(f"{i}-{k}".encode()).hexdigest() for k in range(600)) for i in range(40)]
    made = [(f"s{i}", None, "t1", "add", "describe", ADD + t, ("pool", None, None, None, None, None, 1, None, {})) for i, t in enumerate(texts)]
    attempts = spark.createDataFrame(made, ATTEMPTS).withColumn("pos", F.monotonically_increasing_id())
    tables = f"{staging.shared_root(spark)}/evalmill-tables/{spark.sparkContext.applicationId}"
    before = set(V.names(spark, tables))
    run = Run(spark, str(tmp_path), "run-1")
    out = run.run_once(attempts, spark.createDataFrame([("t1", "add", "p", "s", CHECK)], TASKS), 10.0)
    assert out.where("all_tests_passed").count() == len(texts)
    assert set(V.names(spark, tables)) == before  # what seed and batches staged is gone
    whole = sum(map(len, texts))
    assert size(tmp_path / "run-1" / "jobs") < 0.8 * whole and size(tmp_path) < 2 * whole
    paths = run.export()
    assert size(tmp_path / "run-1" / "export") < 1 * whole and spark.read.json(paths["attempts"]).count() == len(texts)


def test_scratch_deletes_what_was_staged_within(spark):
    kept = staging.staged(spark.range(3), "outside")
    with staging.scratch(spark):
        one = staging.staged(spark.range(5), "inside")
        with staging.scratch(spark):
            two = staging.staged(one, "inner")
            assert two.count() == 5
        assert not os.path.exists(two.inputFiles()[0].removeprefix("file://"))
        assert one.count() == 5
    assert not os.path.exists(one.inputFiles()[0].removeprefix("file://")) and kept.count() == 3
