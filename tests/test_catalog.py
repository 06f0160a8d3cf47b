"""Every catalog query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from evalmill.plans.queries import ORACLE, QUERIES, enriched, sizes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr(tuple(r[k] for k in order)) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows([c[0] for c in want.description], want.fetchall())


def test_analysis_by_zstd_lengths(spark, duck):
    """Quartiles, slices and objective, by plain Python from the frames' real sizes."""
    import statistics

    import zstandard

    size = {pos: len(zstandard.ZstdCompressor(level=22).compress(t.encode())) for pos, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    order = sorted(size.values())
    p25, p75 = (order[round(q * (len(order) - 1))] for q in (0.25, 0.75))
    p50 = int(statistics.median(order))
    quartile = {k: "Q1" if n <= p25 else "Q2" if n <= p50 else "Q3" if n <= p75 else "Q4" for k, n in size.items()}
    got = {r.pos: r for r in QUERIES["enriched_rows_zstd"](spark, SF).collect()}
    assert {k: (r.decoder_input_len_zstd22, r.compression_quartile) for k, r in got.items()} == {k: (size[k], quartile[k]) for k in size}
    plain = {r.pos: r for r in QUERIES["enriched_rows"](spark, SF).collect()}
    assert any(plain[k].compression_quartile != quartile[k] for k in size)
    tested = {k: bool(r.all_tests_passed) for k, r in got.items() if r.has_test_outcome and r.outcome_kind == "tested"}
    want = {q: (sum(x == q for x in quartile.values()), sum(quartile[k] == q for k in tested), sum(p for k, p in tested.items() if quartile[k] == q)) for q in set(quartile.values())}
    slices = QUERIES["slices_all_zstd"](spark, SF).where("slice_name = 'by_compression_quartile'").collect()
    assert {r.slice_key: (r.row_count, r.tested_count, r.pass_count) for r in slices} == want
    objective = {r.pos: r.objective for r in QUERIES["joint_objective_zstd"](spark, SF).collect()}
    assert objective == pytest.approx({k: p - 0.001 * size[k] for k, p in tested.items()})


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_the_columns_they_need(spark):
    """Projections and filters reach the Parquet scan."""
    plan = plan_of(QUERIES["results_per_run"](spark, SF))
    assert "n_chars" not in plan.split("ReadSchema", 1)[1]
    assert "lang" not in plan_of(QUERIES["slices_all"](spark, SF))
    plan = plan_of(sizes(spark, SF).groupBy("decoder_input_len_zstd22").count())
    assert "ReadSchema: struct<text:string>" in plan  # cut points read the texts alone


@pytest.mark.parametrize("name", ["latest_outcome", "enriched_rows", "slices_all", "dedup_first_match"])
def test_last_rows_are_found_without_sorting_wide_rows(spark, name):
    assert "SortAggregate" not in plan_of(QUERIES[name](spark, SF))


def test_cut_points_need_no_joins(spark):
    """Quartile cuts come from a scan of the attempts that is over before: enriched rows are planned once."""
    plan = plan_of(QUERIES["enriched_rows"](spark, SF))
    assert plan.count("FileScan") == plan_of(enriched(spark, SF)).count("FileScan")


def test_refused_rows_do_not_end_the_checks(spark, tmp_path):
    """Null and empty texts, and a null id, are told like the others, as SQL does; the checks themselves still refuse them."""
    from evalmill.schemas import SOURCES, non_empty, refused

    made = [(0, "one", "a", 3), (1, "", "a", 0), (2, None, "b", None), (3, " ", None, 1), (None, "four", "a", 4), (5, "", "a", 0)]
    spark.createDataFrame(made, "doc_id bigint, text string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want, df = con.execute(ORACLE["checked_attempts"]), QUERIES["checked_attempts"](spark, str(tmp_path))
    got = df.collect()
    assert len(got) == 6 and rows(df.columns, map(tuple, got)) == rows([c[0] for c in want.description], want.fetchall())
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    told = {r.doc_id: r.why for r in docs.select("doc_id", refused(("text",), {"source": SOURCES}).alias("why")).collect()}
    assert told == {0: ["source"], 1: ["text", "source"], 2: ["text", "source"], 3: ["source"], None: ["source"], 5: ["text", "source"]}
    with pytest.raises(Exception, match="text must be non-empty"):
        docs.select(non_empty("text")).collect()
