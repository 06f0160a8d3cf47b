"""The event log of runs as a stream: each event once, stage timing with state, and rates and counts that are kept up to date.

An event may be delivered again and out of order, within a delay that the watermark trails the latest event by. Results equal those of the batch rules in operators.events on the
same events, whatever their order of arrival.

Queries are joined by files, like the stages of a run: changes of timing are appended by one query, and another one adds them up. All of them can be stopped and started again on
their checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import events as E
from ..operators.outcomes import latest
from ..schemas import EVENTS
from ..sources.versions import Table
from ..staging import staged

#: Columns of the log that the operators use; seq orders the events of a job.
LOG = "seq BIGINT, run_id STRING, job_id STRING, stage STRING, event STRING, ts TIMESTAMP, task_id STRING, sample_id STRING"
CHANGES = "job_id STRING, stage STRING, rev BIGINT, latency_us BIGINT, outputs BIGINT, total_us BIGINT"
_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def log_lines(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    """A run's event files as a stream of LOG; the order of a job's events is that of their times, a start before an output of the same time."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).option("maxFileAge", "36500d").json(path)
    attempt = lambda c: F.get_json_object("payload", f"$.payload.attempt.{c}").alias(c)
    ts = F.to_timestamp("timestamp")
    seq = F.unix_micros(ts) * 4 + F.when(F.col("event") == E.STARTED, 0).when(F.col("event") == E.OUTPUT, 1).otherwise(2)
    return raw.select(seq.alias("seq"), "run_id", "job_id", "stage", "event", ts.alias("ts"), attempt("task_id"), attempt("sample_id"))


def once(events: DataFrame, delay: str = "1 day", *key: str) -> DataFrame:
    """A stream of events with each of them once: what comes again within the delay is dropped, by its job, stage, event and seq unless another key is given."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(key) or ["run_id", "job_id", "stage", "event", "seq"])


#: Groups of jobs and stages whose state is read, merged with a batch's events column by column, and written once for a batch.
GROUPS = 128
_PAIRS = {"job_id": "string", "stage": "string", "start_seq": "int64", "start_us": "int64", "out_seq": "int64", "out_us": "int64", "latency": "int64", "rev": "int64", "last_ms": "int64"}
_LATER = {"job_id": "string", "stage": "string", "seq": "int64", "us": "int64"}
_KEY = ["job_id", "stage"]


def _packed(frame: pd.DataFrame, columns: dict[str, str]) -> bytes:
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(frame, pa.schema([(c, pa.type_for_alias(t)) for c, t in columns.items()]), preserve_index=False)
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, batch.schema) as w:
            w.write_batch(batch)
        return out.getvalue().to_pybytes()


def _unpacked(data: bytes | None, columns: dict[str, str]) -> pd.DataFrame:
    import pyarrow as pa

    types = {pa.int64(): pd.Int64Dtype(), pa.string(): pd.StringDtype()}
    schema = pa.schema([(c, pa.type_for_alias(t)) for c, t in columns.items()])
    table = schema.empty_table() if data is None else pa.ipc.open_stream(data).read_all()
    return table.to_pandas(types_mapper=types.get)


def merged(pairs: pd.DataFrame, later: pd.DataFrame, events: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """Pairs and later starts of many jobs and stages after some events (job_id, stage, event, seq, us), and the pairs whose latency has changed, with the one before as `was`."""
    codes = pd.concat([pairs[_KEY], later[_KEY], events[_KEY]], ignore_index=True).groupby(_KEY, dropna=False, sort=False).ngroup().to_numpy()
    # a key of pairs has its row's number as code, as pairs come first and hold a key once
    n, m = len(pairs), len(pairs) + len(later)
    later, events = later.assign(key=codes[n:m]), events.assign(key=codes[m:])
    keys = pd.concat([pairs[_KEY], events.drop_duplicates("key").loc[lambda e: e["key"] >= n, _KEY]], ignore_index=True)
    old = pairs.reindex(keys.index)
    at = ["key", "seq", "us"]
    side = lambda seq, us: pd.DataFrame({"key": codes[:n], "seq": pairs[seq], "us": pairs[us]}).dropna()
    last = lambda rows: rows.sort_values(at).drop_duplicates("key", keep="last").set_index("key")[["seq", "us"]].reindex(keys.index)
    out = last(pd.concat([side("out_seq", "out_us"), events.loc[events["event"] == E.OUTPUT, at]]))
    starts = pd.concat([side("start_seq", "start_us"), later[at], events.loc[events["event"] == E.STARTED, at]])
    upto = out["seq"].reindex(starts["key"]).array
    start = last(starts[(starts["seq"].array < upto).fillna(False)])
    rest = starts[(starts["seq"].array > upto).fillna(True)].drop_duplicates().sort_values(at)
    now = out["us"] - start["us"]
    changed = (now.notna() & (old["latency"].isna() | (now != old["latency"]).fillna(True))).astype(bool)
    seen = (events.groupby("key")["us"].max() // 1000).reindex(keys.index)
    new = keys.assign(
        start_seq=start["seq"], start_us=start["us"], out_seq=out["seq"], out_us=out["us"], latency=now, rev=old["rev"].fillna(0) + changed.astype("Int64"), last_ms=pd.concat([old["last_ms"], seen], axis=1).max(axis=1).astype("Int64")
    )
    pending = keys.loc[rest["key"]].reset_index(drop=True).assign(seq=rest["seq"].array, us=rest["us"].array)
    return new, pending, new[changed].assign(was=old.loc[changed, "latency"])


class Timing(StatefulProcessor):
    """Per job and stage the last output and the latest start before it, whatever the order of arrival; of a group of them at once.

    The state is that pair and the starts after it, for outputs that are still to come. Each change of the latency gives a row with its difference to the last one, so rows can be added up. A timer
    clears what belongs to a job and stage when the watermark is `keep_ms` past its last event; a group's timer is that of the first one to go.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pairs = handle.getValueState("pairs", "rows binary, timer_ms bigint")
        self.later = handle.getValueState("later", "rows binary")

    def _held(self) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
        pairs, timer = self.pairs.get() if self.pairs.exists() else (None, None)
        later = self.later.get()[0] if pairs is not None else None
        return _unpacked(pairs, _PAIRS), _unpacked(later, _LATER), timer

    def _hold(self, pairs: pd.DataFrame, later: pd.DataFrame, timer: int | None) -> None:
        """timer: the one that is set."""
        due = None if pairs.empty else int(pairs["last_ms"].min()) + self.keep_ms
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if due is None:
            self.pairs.clear()
            self.later.clear()
        else:
            self.pairs.update((_packed(pairs, _PAIRS), due))
            self.later.update((_packed(later, _LATER),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pairs, later, timer = self._held()
        whole = {"job_id": pd.StringDtype(), "stage": pd.StringDtype(), "seq": pd.Int64Dtype(), "us": pd.Int64Dtype()}
        pairs, later, changed = merged(pairs, later, pd.concat([f[["job_id", "stage", "event", "seq", "us"]] for f in rows], ignore_index=True).astype(whole))
        self._hold(pairs, later, timer)
        if len(changed):
            yield pd.DataFrame({
                "job_id": changed["job_id"], "stage": changed["stage"], "rev": changed["rev"], "latency_us": changed["latency"],
                "outputs": changed["was"].isna().astype("int64"), "total_us": changed["latency"] - changed["was"].fillna(0),
            })

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pairs, later, _ = self._held()
        over = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        gone = pairs["last_ms"] + self.keep_ms <= over
        kept = later.merge(pairs.loc[~gone, _KEY], on=_KEY)  # nulls are keys like others
        self._hold(pairs[~gone], kept, None)  # a timer that has expired is gone
        return iter(())

    def close(self) -> None:
        pass


def timing_changes(events: DataFrame, keep: int = 7 * 86_400, groups: int = GROUPS) -> DataFrame:
    """A stream of CHANGES from a stream of events (with a watermark). keep: seconds after a job's last event in a stage for which its state stays; a later output is timed from a later start only.
    groups: into how many groups jobs and stages are dealt; it has to stay as it is while a checkpoint is used."""
    own = F.pmod(F.xxhash64(F.col("job_id").cast("string"), "stage"), F.lit(groups)).alias("group")
    rows = events.where(F.col("event").isin(E.STARTED, E.OUTPUT)).select(own, F.col("job_id").cast("string").alias("job_id"), "stage", "event", "seq", E.micros("ts").alias("us"), "ts")
    return rows.groupBy("group").transformWithStateInPandas(Timing(keep * 1000), CHANGES, "Append", "EventTime")


def timing_of(changes: DataFrame) -> DataFrame:
    """What stage_timing gives, from the changes so far."""
    return latest(changes, "job_id", "stage", pos="rev").select("job_id", "stage", "latency_us")


def rates(changes: DataFrame) -> DataFrame:
    """Outputs and their time by stage, added up; of a stream, kept up to date."""
    return changes.groupBy("stage").agg(F.sum("outputs").alias("outputs"), F.sum("total_us").alias("total_us"))


def with_rate(sums: DataFrame) -> DataFrame:
    us, n = F.col("total_us"), F.col("outputs")
    return sums.withColumn("samples_per_second", E._rate(n, us))


def counts(events: DataFrame) -> DataFrame:
    """Starts, outputs and ends by run and stage; of a stream, kept up to date."""
    return events.groupBy("run_id", "stage").agg(*(F.count_if(F.col("event") == kind).alias(name) for kind, name in ((E.STARTED, "started"), (E.OUTPUT, "completed"), (E.TERMINAL, "terminals"))))


def job_tasks(events: DataFrame) -> DataFrame:
    """Per job the task of its last terminal event that tells one; of a stream, kept up to date."""
    return events.where((F.col("event") == E.TERMINAL) & F.col("task_id").isNotNull()).groupBy("job_id").agg(F.max_by("task_id", "seq").alias("task_id"))


@contextmanager
def _rocks(spark: SparkSession):
    """The state store that transformWithState needs, for queries that are started within."""
    before = spark.conf.get(_ROCKS[0], None)
    spark.conf.set(*_ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ROCKS[0])
        else:
            spark.conf.set(_ROCKS[0], before)


def append(rows: DataFrame, path: str, checkpoint: str, **trigger: Any):
    """A query that appends a stream to Parquet files, each row once, also if it is stopped and started again."""
    with _rocks(rows.sparkSession):
        return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)


def keep(rows: DataFrame, table: Table, checkpoint: str, **trigger: Any):
    """A query that puts the rows that have changed into a keyed table, whose order column is the number of the batch."""

    def batch(changed: DataFrame, n: int) -> None:
        # the batch's plan updates the state, so it runs once and the table takes the rows as they were written
        table.upsert(staged(changed.withColumn(table.order, F.lit(n).cast("long")), "changed"))

    with _rocks(rows.sparkSession):
        return rows.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_changes(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", max_files).option("maxFileAge", "36500d").parquet(path)
