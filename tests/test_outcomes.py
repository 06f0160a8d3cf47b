"""Join of attempts and outcomes, quartiles, slices: fixture rows and differential tests against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from evalmill.operators import outcomes as O
from evalmill.operators import slices as S
from evalmill.operators import stats as T

ATTEMPT = "pos long, sample_id string, run_id string, task_id string, entry_point string, decoder_input string, raw_output string, provenance_source string, provenance_model string, provenance_occurrence_count long"
PARSE = "pos long, sample_id string, run_id string, parse_success boolean, skip_reason string"
TEST = "pos long, sample_id string, run_id string, outcome_kind string, tests_ran boolean, all_tests_passed boolean, test_pass_rate double, skipped boolean, skip_reason string"


def attempt(pos, sample, run=None, weight=1, model="model-a", source="pool"):
    return (pos, sample, run, "HumanEval/0", "has_close_elements", "def foo(): pass", "out", source, model, weight)


def test_(pos, sample, run=None, kind="tested", passed=True):
    return (pos, sample, run, kind, kind == "tested", passed if kind == "tested" else None, 1.0, kind == "skipped", None)


test_.__test__ = False


def rows(spark, attempts, parse, tests):
    return O.enriched(spark.createDataFrame(attempts, ATTEMPT), spark.createDataFrame(parse, PARSE), spark.createDataFrame(tests, TEST))


def test_full_match(spark):
    r = O.with_quartile(rows(spark, [attempt(0, "s1")], [(0, "s1", None, True, None)], [test_(0, "s1")]))
    one = r.first()
    assert one.has_test_outcome and one.all_tests_passed and one.compression_quartile == "Q1"
    assert O.coverage(r).first().asDict() == {"attempt_count": 1, "matched_parse": 1, "matched_test": 1}


def test_missing_and_weight(spark):
    r = rows(spark, [attempt(0, "s1"), attempt(1, "s2", weight=42), attempt(2, "s2")], [(0, "s1", None, True, None), (1, "s2", None, False, "no_valid_candidate")], [test_(0, "s1")])
    assert [x.sample_id for x in O.missing(r, "test").collect()] == ["s2", "s2"]
    assert r.where("pos = 1").first().provenance_occurrence_count == 42


def test_newest_outcome_of_another_run_is_missing(spark):
    tests = [test_(0, "s1", "run-1"), test_(1, "s1", "run-2")]
    r = rows(spark, [attempt(0, "s1", "run-1"), attempt(1, "s1"), attempt(2, "s1", "run-2")], [], tests)
    assert [x.has_test_outcome for x in r.orderBy("pos").collect()] == [False, True, True]
    assert O.untested_ids(spark.createDataFrame([attempt(0, "s1", "run-1")], ATTEMPT), spark.createDataFrame(tests, TEST)).count() == 0


def test_join_equals_a_fold(spark):
    rng = random.Random(3)
    runs = [None, "a", "b"]
    attempts = [attempt(i, f"s{rng.randint(0, 20)}", rng.choice(runs)) for i in range(60)]
    tests = [test_(i, f"s{rng.randint(0, 20)}", rng.choice(runs), passed=rng.random() < 0.5) for i in range(80)]
    last = {}
    for t in tests:
        last[t[1]] = t
    want = []
    for a in attempts:
        t = last.get(a[1])
        want.append(t[0] if t and (a[2] is None or t[2] is None or a[2] == t[2]) else None)
    got = O.with_outcome(spark.createDataFrame(attempts, ATTEMPT), spark.createDataFrame(tests, TEST), "t").orderBy("pos").select("t.pos").collect()
    assert [x[0] for x in got] == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 50, 101])
def test_percentiles_follow_the_nearest_rank_rule(spark, n):
    rng = random.Random(n)
    v = sorted(rng.randint(0, 30) for _ in range(n))
    at = lambda p: v[round(p / 100 * (n - 1))] if v else 0
    got = O.percentiles(spark.createDataFrame([(x,) for x in v], "v long"), "v", (25, 50, 75, 90)).first()
    assert tuple(got) == (at(25), int(statistics.median(v)) if v else 0, at(75), at(90))


def test_ranks_of_values_that_all_differ(spark):
    """Only the ranges that hold a rank are added up, in a window over ranges; no task sees all values."""
    v = random.Random(1).sample(range(-(10**12), 10**12), 3000)
    hist = spark.createDataFrame([(x, 1 + x % 3) for x in v], "v long, c long").repartition(6)
    every = sorted(x for x in v for _ in range(1 + x % 3))
    ranks = [0, 1, 17, len(every) // 2, len(every) - 2, len(every) - 1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, though the values are few
    try:
        assert O.ranked_values(hist, lambda n: ranks * (n == len(every))) == {r: every[r] for r in ranks} and O.ranked_values(hist, lambda n: []) == {}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = spark.createDataFrame([(x,) for x in v], "v long")
    for frame in (O.percentiles(rows, "v", (25, 50, 90)), O.with_quartile(rows, "v")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SinglePartition" not in plan
    assert {r["count"] for r in O.with_quartile(rows, "v").groupBy("compression_quartile").count().collect()} <= {749, 750, 751}


ENRICHED = "pos long, sample_id string, provenance_source string, provenance_model string, task_id string, provenance_occurrence_count long, parse_success boolean, has_test_outcome boolean, outcome_kind string, all_tests_passed boolean, compression_quartile string, decoder_input_len_zstd22 long, has_parse_outcome boolean"


def enriched(spark, *some):
    base = {"provenance_source": "pool", "provenance_model": "model-a", "task_id": "HumanEval/0", "provenance_occurrence_count": 1, "parse_success": True, "has_test_outcome": True, "outcome_kind": "tested", "all_tests_passed": True, "compression_quartile": "Q2", "decoder_input_len_zstd22": 50, "has_parse_outcome": True}
    return spark.createDataFrame([{"pos": i, "sample_id": f"s{i}"} | base | x for i, x in enumerate(some)], ENRICHED)


def test_rates_leave_infra_errors_out(spark):
    r = enriched(spark, {}, {"all_tests_passed": False}, {"outcome_kind": "infra_error", "all_tests_passed": None})
    one = S.summary(r).first()
    assert (one.tested_pass_count, one.tested_fail_count, one.correctness_pass_rate) == (1, 1, 0.5)
    assert {x.outcome_kind: x.row_count for x in S.outcome_kinds(r).collect()} == {"tested": 2, "infra_error": 1}


def test_weighted_rate_null_flag_and_empty(spark):
    r = enriched(spark, {"provenance_occurrence_count": 10}, {"all_tests_passed": None})
    assert S.summary(r).first().correctness_pass_rate_weighted == 10 / 11
    assert S.summary(r.limit(0)).first().correctness_pass_rate is None
    assert S.slice_by(enriched(spark, {"outcome_kind": "skipped"}), F.col("provenance_source")).first().pass_rate is None


def test_slices(spark):
    r = enriched(spark, {}, {"provenance_source": "fresh_stub", "all_tests_passed": False, "provenance_model": ""}, {"provenance_model": None, "compression_quartile": None})
    got = {(x.slice_name, x.slice_key): x.pass_rate for x in S.all_slices(r).collect()}
    assert got[("by_source", "fresh_stub")] == 0.0 and got[("by_source", "pool")] == 1.0
    assert got[("by_model", "(unknown)")] == 0.5 and got[("by_compression_quartile", "(unknown)")] == 1.0
    assert {k for k, _ in got} == {"by_source", "by_model", "by_task", "by_compression_quartile"}


def test_funnel(spark):
    r = enriched(spark, {"provenance_occurrence_count": 3}, {"parse_success": False, "has_test_outcome": False, "outcome_kind": None, "all_tests_passed": None})
    f = S.funnel(r).first()
    assert (f.raw_count, f.parse_success_count, f.tested_count, f.all_tests_passed_count, f.raw_weighted_count, f.all_tests_passed_weighted_count) == (2, 1, 1, 1, 4, 3)


def test_seed_digest_depends_on_order(spark):
    import hashlib

    ids = lambda *x: spark.createDataFrame([(i, s, "t") for i, s in enumerate(x)], "pos long, sample_id string, task_id string")
    a, b = (O.seed_digest(ids(*x)).first().sample_ids_hash for x in (("sample-a", "sample-b"), ("sample-b", "sample-a")))
    assert a != b and a == hashlib.sha256(b"sample-a\0sample-b\0").hexdigest()
    assert O.seed_digest(ids().limit(0)).first().sample_ids_hash == hashlib.sha256(b"").hexdigest()


def test_limits_and_selection(spark):
    r = spark.createDataFrame([(i, f"t{i % 2}") for i in range(6)], "pos long, task_id string")
    take = lambda df: sorted(x.pos for x in df.collect())
    assert take(T.slice_limit(r, 2)) == [0, 1] and take(T.slice_limit(r, 0)) == [] and take(T.slice_limit(r, -2)) == [0, 1, 2, 3]
    assert take(T.limit_per(r, "task_id", 0)) == [0, 1]
    tasks = spark.createDataFrame([("a", 1), ("b", 2)], "task_id string, x int")
    assert [x.task_id for x in T.select_tasks(tasks, ["b", "a"]).collect()] == ["b", "a"]
    with pytest.raises(Exception, match="unknown task"):
        T.select_tasks(tasks, ["z"]).collect()
    top = spark.createDataFrame([(0, "x"), (1, "y"), (2, "y"), (3, "z"), (4, "z")], "pos long, task_id string")
    assert [x.task_id for x in T.top_tasks(top, 2).collect()] == ["y", "z"]


def test_metadata(spark):
    t = spark.createDataFrame([("a", "i", "s"), ("b", "i", None)], "run_id string, init string, seed string")
    new = spark.createDataFrame([("a", "n"), ("c", "n")], "run_id string, init string")
    assert {tuple(x) for x in O.insert_if_absent(t, new).collect()} == {("a", "i", "s"), ("b", "i", None), ("c", "n", None)}
    assert ("a", "n", None) in {tuple(x) for x in O.insert_if_absent(t, new, True).collect()}
    seeds = spark.createDataFrame([("a", "x"), ("b", "x")], "run_id string, seed string")
    assert {(x.run_id, x.seed, x.accepted) for x in O.set_seed(t, seeds).collect()} == {("a", "s", False), ("b", "x", True)}


def test_numbered(spark):
    rng = random.Random(2)
    values = rng.sample(range(1000), 50)
    rows = spark.createDataFrame([(v,) for v in values], "pos long").repartition(7)
    assert [r.at for r in T.numbered(rows, "at").orderBy("pos").collect()] == list(range(50))
    assert T.numbered(rows.limit(0), "at").count() == 0


def test_outcomes_laid_out_by_sample_are_not_shuffled(spark, tmp_path):
    """The last record of each sample without an exchange, and joined with attempts by an exchange of these alone; also in a session that has to be told of the table."""
    from evalmill.sources import sinks

    schema = "sample_id string, run_id string, outcome_kind string, pos long"
    rows = [(f"s{k % 40}", None, f"kind{k}", k) for k in range(200)]
    sinks.write_bucketed(spark.createDataFrame(rows, schema), "outcomes_by_sample", str(tmp_path / "b"), 4)
    again = sinks.open_bucketed(spark, "outcomes_opened", str(tmp_path / "b"), schema, 4)
    attempts = spark.createDataFrame([(k, f"s{k}", None) for k in range(50)], "pos long, sample_id string, run_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table in (spark.table("outcomes_by_sample"), again):
            last, joined = O.latest(table, "sample_id"), O.with_outcome(attempts, table, "t")
            plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan(last) and plan(joined).count("Exchange") == 1 and plan(joined).count("Bucketed: true") >= 2
            assert {(r.sample_id, r.pos) for r in last.collect()} == {(f"s{k}", 160 + k) for k in range(40)}
            assert joined.where("t is not null").count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("outcomes_by_sample", "outcomes_opened"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
