"""Small documents, written and read through Hadoop's file system."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import file_system


def write_text(spark: SparkSession, text: str, path: str) -> None:
    target, fs = file_system(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    source, fs = file_system(spark, path)
    stream = fs.open(source)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_document(spark: SparkSession, document: Any, path: str) -> None:
    write_text(spark, json.dumps(document, indent=2, ensure_ascii=False) + "\n", path)


def write_document_with_lists(spark: SparkSession, document: Any, lists: dict[str, DataFrame], path: str) -> None:
    """A document in which a list of one string, a key of lists, stands for a long one: the rows (at from 0, value) of that key, one element to a line. The rows don't pass through the
    driver, and the task that writes the file holds a part of them at a time."""
    lines, n, rest = None, 0, json.dumps(document, indent=2, ensure_ascii=False)
    text = lambda line: spark.range(1).select(F.lit(n).alias("section"), F.lit(0).cast("long").alias("at"), F.lit(line).alias("line"))
    for mark, rows in sorted(lists.items(), key=lambda x: rest.index(json.dumps(x[0]))):
        before, _, rest = rest.partition(json.dumps(mark))
        element = F.regexp_extract(F.to_json(F.array("value")), r"(?s)^\[(.*)\]$", 1)
        more = rows.select(F.lit(n + 1).alias("section"), "at", F.concat(F.when(F.col("at") > 0, ", ").otherwise(""), element).alias("line"))
        lines = (text(before) if lines is None else lines.unionByName(text(before))).unionByName(more)
        n += 2
    lines = text(rest) if lines is None else lines.unionByName(text(rest))
    beside = f"{path.rpartition('/')[0]}/.new-{uuid.uuid4().hex}"
    lines.repartition(1).sortWithinPartitions("section", "at").select("line").write.text(beside)
    glob, fs = file_system(spark, f"{beside}/part-*")
    target = file_system(spark, path)[0]
    fs.delete(target, False)
    if not fs.rename(fs.globStatus(glob)[0].getPath(), target):
        raise OSError(f"cannot write {path}")
    fs.delete(file_system(spark, beside)[0], True)


def read_document(spark: SparkSession, path: str) -> Any:
    return json.loads(read_text(spark, path))
