"""Queries run in one session, in any order, whatever the session has done before."""

from pyspark.sql import Observation
from pyspark.sql import functions as F

import corpus_pipeline
from evalmill.llm import common, secret_scan
from evalmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_secrets_after_other_queries(spark):
    assert QUERIES["op8_ngram_jaccard"](spark, SF).count() > 0
    assert corpus_pipeline.run(spark, SF).count() > 0
    first = sorted(map(tuple, QUERIES["op4_secret_scan"](spark, SF).collect()))
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 3
    assert sorted(map(tuple, QUERIES["op4_secret_scan"](spark, SF).collect())) == first
    common.release(spark)


def test_a_trained_forest_has_no_summary(spark):
    assert not secret_scan.train(secret_scan.labelled_findings(spark, 200), frozenset()).hasSummary
