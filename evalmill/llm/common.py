"""What the operators of this subpackage share: staging in the shared folder, batch bounds, column helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch between the JVM and a Python worker: with whole texts of up to
#: some hundred kilobytes, a batch stays far below the memory of a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

_local_roots: dict[str, str] = {}


#: Rows of a batch that are packed stretches of a corpus, of some hundred kilobytes each.
PACKED_ROWS = 16


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small; a smaller setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows or now in (BATCH_ROWS, PACKED_ROWS):
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Row by row, so that one packed row at a time is copied."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def relieve() -> None:
    """Give freed memory back to the system: workers are used again, and share an executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What a worker keeps from task to task, by the module whose functions use it.
_kept: dict[str, dict] = {}


def kept(module: str) -> dict:
    """The things that tasks of a module's functions share in a worker. Those of other modules go, as workers outlive stages."""
    others = [m for m in _kept if m != module]
    for m in others:
        del _kept[m]
    if others:
        relieve()
    return _kept.setdefault(module, {})


def _relieved(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], module: str, each: int = 64):
    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(module)
        for n, batch in enumerate(f(batches), 1):
            yield batch
            if n % each == 0:
                relieve()
        relieve()

    return g


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a folder of our own."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _local_roots:
        _local_roots[app] = "file://" + tempfile.mkdtemp(prefix="evalmill-")
    return _local_roots[app]


#: Options of Parquet for rows of megabytes: pages of a row and row groups of about one, as readers hold a row group's columns, and codecs a page, at once.
ROW_BY_ROW = {"parquet.page.row.count.limit": 1, "parquet.page.size.row.check.min": 1, "parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}

#: Folders that staged() has written, by application, in order.
_written: dict[str, list[str]] = {}


def staged(df: DataFrame, name: str, options: dict[str, int] | None = None) -> DataFrame:
    """df as written to the shared folder: cuts the lineage, outlives executors, and is read as often as needed.

    The folder is <shared root>/evalmill/<application>/<name>-<random>; release() removes them.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/evalmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """The place in the list of written folders, for release()."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, but_last: int = 0) -> None:
    """Delete what staged() has written in this application since a mark, but the last so many folders; call it once results are stored."""
    app = spark.sparkContext.applicationId
    paths = _written.get(app, [])
    gone = paths[since : len(paths) - but_last]
    for p in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _written[app] = [p for p in paths if p not in gone]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(col: str = "text") -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> F.Column:
    """One key for equal (id, text): rows that repeat an id with another text stay apart."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


#: Keys up to which a set of dropped rows is broadcast; more are taken out by a shuffled join.
BROADCAST_ROWS = 1 << 20


def own_name(name: str) -> str:
    """A column name that no input has."""
    return f"__{name}_{uuid.uuid4().hex}"


def small_side(df: DataFrame, most: int | None = None) -> DataFrame:
    """df marked for broadcast if it has few rows; df should be staged, as it is counted."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """All bytes of the texts: what sizes the parts that tasks hold at once."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(whole_text(text_col)).cast("long")), F.lit(0)).alias("n")).first().n


def parts_for(spark: SparkSession, amount: int, each: int, times: int = 1) -> int:
    """Parts of at most about so much each, and `times` for each shuffle partition at least: their number grows with the input, not their size."""
    return max(times * partitions(spark), -(-amount // each))


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less the rows whose keys are in dropped (rk, h: row_key and xxhash64 of the text, both over null as empty)."""
    rk, h, text = own_name("rk"), own_name("h"), whole_text(text_col)
    side = small_side(staged(dropped.distinct(), "dropped")).select(F.col("rk").alias(rk), F.col("h").alias(h))
    return docs.join(side, (F.xxhash64(F.col(id_col).cast("long"), text) == F.col(rk)) & (F.xxhash64(text) == F.col(h)), "left_anti")


def kept_batches(docs: DataFrame, keep: Callable[[], Callable[[list[bytes]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose texts a function keeps; keep() makes the function once per task."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stays = keep()
        for batch in batches:
            yield batch.filter(pa.array(stays(texts_of(batch[text_col])), pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_relieved(f, keep.__module__), docs.schema)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    bounded_batches(df.sparkSession, rows)
    return df.mapInArrow(_relieved(f, f.__module__), schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
