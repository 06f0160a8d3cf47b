"""Attempts with their outcomes: last record per sample, compatible runs, coverage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _extreme(rows: DataFrame, keys: tuple[str, ...], pos: str, last: bool, null_keys: bool = False) -> DataFrame:
    """Rows at their key's extreme pos. Only keys and pos are aggregated (by hash, if pos is a number); the wide rows are shuffled once and
    not sorted. Both sides share the partitioning by key, as pos is compared and not joined on."""
    at = rows.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg((F.max if last else F.min)(pos).alias("__at"))
    same = None
    for k in keys:
        equal = F.col(k).eqNullSafe(F.col(f"__{k}")) if null_keys else F.col(k) == F.col(f"__{k}")
        same = equal if same is None else same & equal
    reached = F.col(pos) >= F.col("__at") if last else F.col(pos) <= F.col("__at")
    return rows.join(at.hint("shuffle_hash"), same & reached, "left_semi")


def latest(outcomes: DataFrame, *keys: str, pos: str = "pos", null_keys: bool = False) -> DataFrame:
    """The last row per key; pos is unique within a key, rows with a null pos are left out, and those with a null key unless null is a key like others."""
    return _extreme(outcomes, keys, pos, True, null_keys).select(*keys, *(c for c in outcomes.columns if c not in keys))


def first(rows: DataFrame, *keys: str, pos: str = "pos") -> DataFrame:
    """The first row per key; see latest()."""
    return _extreme(rows, keys, pos, False).select(*keys, *(c for c in rows.columns if c not in keys))


def compatible(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def with_outcome(attempts: DataFrame, outcomes: DataFrame, name: str, check_run: bool = True) -> DataFrame:
    """attempts with a struct column of the sample's last outcome: null where there is none, or where its run differs.

    An older outcome of the right run doesn't stand in for a newer one of another run.
    """
    rest = [c for c in outcomes.columns if c != "sample_id"]
    side = latest(outcomes, "sample_id").select("sample_id", F.struct(*rest).alias(name))
    joined = attempts.join(side, "sample_id", "left")
    if check_run:
        joined = joined.withColumn(name, F.when(compatible(F.col("run_id"), F.col(f"{name}.run_id")), F.col(name)))
    return joined


def measured(attempts: DataFrame) -> DataFrame:
    """attempts with the byte and zstd lengths of their decoder input, without the texts, as a written table: each text is compressed once,
    for cut points and rows alike."""
    from ..functions.compress import zstd_length
    from ..staging import staged

    sized = attempts.withColumns({"decoder_input_len_raw": F.octet_length("decoder_input").cast("long"), "decoder_input_len_zstd22": zstd_length("decoder_input")})
    return staged(sized.drop("decoder_input", "raw_output"), "measured-attempts")


def enriched(attempts: DataFrame, parse: DataFrame, test: DataFrame, zstd: Column | None = None) -> DataFrame:
    """attempts: pos and the flat columns, with their lengths if they come from measured(). zstd: an expression for the compressed length."""
    from ..functions.compress import zstd_length

    rows = with_outcome(with_outcome(attempts, parse, "p"), test, "t")
    known = "decoder_input_len_raw" in attempts.columns
    raw = F.col("decoder_input_len_raw") if known else F.octet_length("decoder_input").cast("long")
    packed = zstd if zstd is not None else F.col("decoder_input_len_zstd22") if known else zstd_length("decoder_input")
    return rows.select(
        "pos", "sample_id", "run_id", "task_id", "entry_point", raw.alias("decoder_input_len_raw"), packed.alias("decoder_input_len_zstd22"),
        *(c for c in attempts.columns if c.startswith("provenance_") and c != "provenance_extra_json"),
        F.col("p.parse_success").alias("parse_success"), F.col("p.skip_reason").alias("parse_skip_reason"),
        F.col("t").isNotNull().alias("has_test_outcome"), F.col("p").isNotNull().alias("has_parse_outcome"),
        *(F.col(f"t.{c}").alias(c) for c in ("outcome_kind", "tests_ran", "all_tests_passed", "test_pass_rate", "skipped", "skip_reason")),
    )


def percentiles(df: DataFrame, value: str, percents: tuple[int, ...]) -> DataFrame:
    """One row p<percent>: nearest rank with half-even rounding; 50 is the truncated mean of the middle two; 0 if empty."""
    hist = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("v")).agg(F.count("*").alias("c"))
    return hist_percentiles(hist, percents)


def ranked_values(hist: DataFrame, ranks_of: Callable[[int], list[int]]) -> dict[int, int]:
    """The values at some ranks (from 0, given the number of rows) of a histogram (v, c), by range: values are dealt into sorted ranges, the counts of the ranges (a row each) tell which ones hold a rank, and only
    within these are counts added up. So no task has more than its range, also where all values differ."""
    from pyspark.sql import Window

    from ..staging import staged

    dealt = staged(hist.select("v", "c").repartitionByRange("v").withColumn("range", F.spark_partition_id()), "ranges")
    sizes = sorted((r.first, r.range, r.n) for r in dealt.groupBy("range").agg(F.min("v").alias("first"), F.sum("c").alias("n")).collect())
    ranks = ranks_of(sum(n for _, _, n in sizes))
    place: dict[int, tuple[int, int]] = {}  # of each rank: its range, and the rank within it
    before = 0
    for _, k, n in sizes:
        place |= {r: (k, r - before) for r in ranks if before <= r < before + n}
        before += n
    upto = F.sum("c").over(Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = dealt.where(F.col("range").isin(*{k for k, _ in place.values()})).withColumn("upto", upto)
    wanted = [(F.col("range") == k) & (F.col("upto") > r) & (F.col("upto") - F.col("c") <= r) for k, r in set(place.values())]
    found = held.where(reduce(lambda a, b: a | b, wanted)).collect() if wanted else []
    value = {(k, r): x.v for k, r in place.values() for x in found if x.range == k and x.upto > r >= x.upto - x.c}
    return {r: value[place[r]] for r in ranks}


def hist_percentiles(hist: DataFrame, percents: tuple[int, ...]) -> DataFrame:
    """percentiles() from a histogram (v, c) of distinct values."""
    of: dict[int, list[int]] = {}

    def ranks_of(n: int) -> list[int]:
        of.update({p: [(n - 1) // 2, n // 2] if p == 50 else [round(p / 100 * (n - 1))] for p in percents} if n else {})
        return sorted({r for own in of.values() for r in own})

    value = ranked_values(hist, ranks_of)
    out = {p: int(sum(value[r] for r in own) / len(own)) for p, own in of.items()}
    return hist.sparkSession.range(1).select(*(F.lit(out.get(p, 0)).cast("long").alias(f"p{p}") for p in percents))


def with_quartile(rows: DataFrame, value: str = "decoder_input_len_zstd22", name: str = "compression_quartile", sizes: DataFrame | None = None) -> DataFrame:
    """Q1 to Q4 by cut points over all rows; equal values share a label.

    sizes: the same values from a cheaper table (the attempts without their outcomes), so that rows need not be computed for the cuts.
    """
    cuts = percentiles(rows if sizes is None else sizes, value, (25, 50, 75))  # one row
    v = F.col(value)
    label = F.when(v.isNull(), None).when(v <= F.col("p25"), "Q1").when(v <= F.col("p50"), "Q2").when(v <= F.col("p75"), "Q3").otherwise("Q4")
    return rows.join(F.broadcast(cuts)).withColumn(name, label).drop("p25", "p50", "p75")


def coverage(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("attempt_count"), F.count_if("has_parse_outcome").alias("matched_parse"), F.count_if("has_test_outcome").alias("matched_test"))


def missing(rows: DataFrame, which: str) -> DataFrame:
    """Attempts without an outcome, in order, repeated as they are."""
    return rows.where(~F.col(f"has_{which}_outcome")).select("pos", "sample_id").orderBy("pos")


def untested_ids(attempts: DataFrame, test: DataFrame) -> DataFrame:
    """Sample ids without any test outcome, whatever its run."""
    return attempts.select("sample_id").join(test.select("sample_id"), "sample_id", "left_anti").distinct().orderBy("sample_id")


def insert_if_absent(table: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """A keyed metadata table after inserting; overwriting replaces the row and clears its seed."""
    fresh = new.select("run_id", "init", F.lit(None).cast("string").alias("seed"))
    if overwrite:
        return table.join(new, "run_id", "left_anti").unionByName(fresh)
    return table.unionByName(fresh.join(table, "run_id", "left_anti"))


def set_seed(table: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seed where none is set; a run that has one keeps it, accepted says which."""
    joined = table.join(seeds.withColumnRenamed("seed", "new_seed"), "run_id", "left")
    return joined.select("run_id", "init", F.coalesce("seed", "new_seed").alias("seed"), (F.col("seed").isNull() & F.col("new_seed").isNotNull()).alias("accepted"))


#: Bytes of ids that travel as one row of seed_digest.
DIGEST_BYTES = 1 << 20


def _packed(batches):
    """Ids of a sorted partition, each with a NUL, in rows of some megabyte."""
    import pyarrow as pa
    from pyspark import TaskContext

    held, size, n = [], 0, 0
    part = TaskContext.get().partitionId()

    def row():
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["part", "n", "ids"])

    for batch in batches:
        for x in batch["sample_id"].to_pylist():
            if x is not None:
                held.append(x.encode() + b"\0")
                size += len(held[-1])
                if size >= DIGEST_BYTES:
                    yield row()
                    held, size, n = [], 0, n + 1
    if held:
        yield row()


def _hashed(batches):
    import hashlib

    import pyarrow as pa

    digest = hashlib.sha256()
    for batch in batches:
        for x in batch["ids"]:
            digest.update(x.as_buffer())
    yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], ["sample_ids_hash"])


def seed_digest(attempts: DataFrame, pos: str = "pos") -> DataFrame:
    """The order-sensitive hash of all sample ids, the tasks in order, and the count.

    Ids are sorted in ranges and packed in parallel; one task then hashes the packed rows one after the other, as SHA-256 has to be, and holds one
    of them at a time. The distinct tasks are a small dimension.
    """
    ranges = attempts.select(pos, "sample_id").repartitionByRange(pos).sortWithinPartitions(pos)
    packed = ranges.mapInArrow(_packed, "part int, n bigint, ids binary")
    hashed = packed.repartition(1).sortWithinPartitions("part", "n").mapInArrow(_hashed, "sample_ids_hash string")
    about = attempts.agg(F.array_join(F.array_sort(F.collect_set("task_id")), ",").alias("task_ids"), F.count("*").alias("expected_jobs"))
    one = about.join(F.broadcast(hashed), F.lit(True), "left")  # one row each; none of hashed where there are no attempts
    return one.select(F.coalesce("sample_ids_hash", F.sha2(F.lit(""), 256)).alias("sample_ids_hash"), "task_ids", "expected_jobs")
