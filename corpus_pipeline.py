"""A training-corpus pipeline: each stage takes what its predecessor kept.

Stages but the last return the columns of documents; the last gives the digests of the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalmill.llm import decontaminate, exact_dedup, near_dups, pieces, toxicity
from evalmill.llm.common import mark, release, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is under 0.5 stay. The model is learned from the whole documents table, not from docs.

    Repeated rows have one score, so they stay or go together; rows with a null id or text are scored like others.
    """
    model = toxicity.train_on(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.filtered(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    Null text counts as empty; of a group of null ids one row stays, of rows that repeat the largest id and the text too. An empty table stays
    empty; other columns may have any names and come through.
    """
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 over five-word shingles connect, the one with the smallest doc_id stays.

    Texts without words (null, empty, white space) are linked with nothing and stay; rows that repeat id and text stay or go together; of several texts
    with the smallest id the one with the least hash of both stays.
    """
    return near_dups.kept_rows(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs stay.

    Documents without words stay; windows of items without an id count too; an empty benchmark drops nothing.
    """
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's ids and decoded text. Null text is empty: only begin and end; repeated rows give equal rows."""
    return pieces.digest(pieces.encoded(docs, pieces.model_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

#: The first and the near-duplicate stage have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written for itself, and its input, is deleted once its result is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark(spark)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, since, but_last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
