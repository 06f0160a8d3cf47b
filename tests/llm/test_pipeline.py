"""The pipeline's stages, each by brute force over what its predecessor kept."""

import gc
import hashlib
import os

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from evalmill.llm import common, decontaminate, exact_dedup, near_dups, pieces, toxicity

from test_large_operators import linked
from test_small_operators import contaminated

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = []
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = common.staged(stage(spark, now, SF), "t")
        if name != names[-1]:
            assert now.columns == docs.columns
        kept.append(now.collect())
    rows = {r.doc_id: r for r in docs.collect()}
    ids = [{r.doc_id for r in k} for k in kept]
    model = toxicity.train_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[0] == {i for i, r in rows.items() if toxicity.score(r.text.encode(), *model) < 0.5} and len(ids[0]) < len(rows)
    last = {rows[i].text: i for i in sorted(ids[0])}
    assert ids[1] == set(last.values()) and len(ids[1]) < len(ids[0])
    assert ids[2] == {c for _, _, c in linked([(i, rows[i].text) for i in sorted(ids[1])], 5, 80)} and len(ids[2]) < len(ids[1])
    assert ids[3] == {r[0] for r in contaminated([(i, rows[i].text) for i in ids[2]], items, 10) if not r[5]} and len(ids[3]) < len(ids[2])
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=pieces.model_path())
    for r in kept[4]:
        own = library.encode(rows[r.doc_id].text, add_bos=True, add_eos=True)
        assert r.n_tokens == len(own) and r.decoded_sha256 == hashlib.sha256(library.decode(own).encode()).hexdigest()
    assert ids[4] == ids[3]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, kept[4]))


def test_stages_keep_columns_of_any_name(spark, docs):
    """Columns that helpers might use as names of their own, and repeated rows."""
    names = ("__rk", "__h", "__keep_id", "rk", "h", "fp", "gid", "owner", "copy", "kind", "label", "token", "nth", "first", "u", "v", "n")
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(f"{k} stays").alias(k) for k in names))
    for stage in (exact_dedup.kept_rows, near_dups.kept_rows):
        left, plain = stage(odd), stage(docs.select("doc_id", "text", "lang", "source", "n_chars"))
        assert left.columns == odd.columns
        rows = left.collect()
        assert sorted((r.doc_id is None, r.doc_id, r.text or "") for r in rows) == sorted((r.doc_id is None, r.doc_id, r.text or "") for r in plain.collect())
        assert all(r[k] == f"{k} stays" for r in rows for k in names)


def test_what_stages_write_is_released(spark, docs):
    since = common.mark(spark)
    exact_dedup.exact_dedup(docs).collect()
    paths = [p.removeprefix("file://") for p in common._written[spark.sparkContext.applicationId][since:]]
    assert len(paths) >= 2 and all(map(os.path.exists, paths))
    common.release(spark, since, but_last=1)
    assert [os.path.exists(p) for p in paths] == [False] * (len(paths) - 1) + [True] and common.mark(spark) == since + 1


def test_stages_on_hard_rows(spark, docs, none):
    """Nulls, repeated rows and an empty table go through; columns stay."""
    small = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (small, small.where("doc_id < 0")):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = common.staged(stage(spark, now, SF), "t")
            assert now.columns == small.columns
        corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    texts = [r.text or "" for r in now.collect()]
    assert len(texts) == len(set(texts))


def test_workers_let_go_of_what_other_stages_kept(spark, docs):
    """Workers are used again by the next stage: the model with its cached runs, and the automaton, are not there any more."""
    rows = docs.select("doc_id", "text").repartition(8)
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")

    def held(batches):
        found = sum(isinstance(x, pieces.Pieces) for x in gc.get_objects()) + len(getattr(common, "_kept", {}).get(decontaminate.__name__, ()))
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64())], ["found"])

    pieces.encoded(rows, pieces.model_path()).collect()
    assert all(r.found == 0 for r in common.map_batches(rows, held, "found long").collect())
    decontaminate.clean_rows(rows, items).collect()
    assert all(r.found == 0 for r in common.map_batches(rows, held, "found long").collect())
