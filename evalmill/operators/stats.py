"""Statistics over attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..staging import staged
from .outcomes import hist_percentiles


def attempt_stats(attempts: DataFrame) -> DataFrame:
    """One row; zeros for no attempts. One scan: histograms of tasks and of both lengths are grouping sets of one aggregation."""
    sized = attempts.select("task_id", F.length("decoder_input").cast("long").alias("d"), F.length("raw_output").cast("long").alias("r"), F.col("provenance_occurrence_count").alias("w"))
    sets = {"t": F.col("task_id"), "d": F.col("d"), "r": F.col("r")}
    hist = sized.groupingSets([[c] for c in sets.values()], *sets.values()).agg(F.grouping_id().alias("g"), F.count("*").alias("c"), F.sum("w").alias("w"))
    hist = staged(hist, "attempt-histograms")
    of = {"t": F.col("g") == 3, "d": F.col("g") == 5, "r": F.col("g") == 6}
    main = hist.where(of["t"]).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("record_count"), F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("weighted_count"), F.count("task_id").alias("unique_tasks"))
    for c, name in (("d", "decoder_input"), ("r", "raw_output")):
        p = hist_percentiles(hist.where(of[c] & F.col(c).isNotNull()).select(F.col(c).alias("v"), "c"), (50, 90))
        main = main.join(F.broadcast(p.select(F.col("p50").alias(f"{name}_length_p50"), F.col("p90").alias(f"{name}_length_p90"))))  # one row each
    return main


def source_breakdown(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy(F.col("provenance_source").alias("source")).agg(F.count("*").alias("row_count")).orderBy("source")


def top_tasks(attempts: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent tasks; of equals, the one seen first."""
    return attempts.groupBy("task_id").agg(F.count("*").alias("row_count"), F.min("pos").alias("first_pos")).orderBy(F.desc("row_count"), "first_pos").limit(n)


def first_samples(attempts: DataFrame, n: int = 3, size: int = 120) -> DataFrame:
    from ..functions.columns import record_preview

    return attempts.orderBy("pos").limit(n).select("pos", *record_preview(size))


def nth_of_task(attempts: DataFrame, task_id: str, n: int = 0, strict: bool = False) -> DataFrame:
    """The nth row of a task, from 0; strict: out of range is an error that names how many there are."""
    if strict:
        have = attempts.where(F.col("task_id") == task_id).count()
        if not 0 <= n < have:
            raise IndexError(f"no row {n} of task {task_id}: it has {have}")
    return attempts.where(F.col("task_id") == task_id).orderBy("pos").offset(n).limit(1)


def first_per(attempts: DataFrame, *keys: str) -> DataFrame:
    from .outcomes import first

    return first(attempts, *keys)


def spot_check(attempts: DataFrame) -> DataFrame:
    """Per task the first pool and the first fresh attempt."""
    at = lambda s: F.min_by("sample_id", F.when(F.col("provenance_source") == s, F.col("pos")))
    return attempts.groupBy("task_id").agg(at("pool").alias("pool_sample_id"), at("fresh_stub").alias("fresh_sample_id")).orderBy("task_id")


def both_sides(attempts: DataFrame, task_id: str) -> dict[str, Row]:
    """The first pool and the first fresh attempt of a task; a side without any is an error."""
    found = {}
    for source in ("pool", "fresh_stub"):
        found[source] = attempts.where((F.col("task_id") == task_id) & (F.col("provenance_source") == source)).orderBy("pos").first()
        if found[source] is None:
            raise ValueError(f"task {task_id} has no {source} attempt")
    return found


def limit_per(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows per file or task; a limit below 1 keeps one, as it is looked at after each row."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return rows.withColumn("__n", nth).where(F.col("__n") <= max(n, 1)).drop("__n")


def slice_limit(rows: DataFrame, n: int | None) -> DataFrame:
    """The slice [:n] by pos: none for 0, all but the last -n for a negative n."""
    if n is None:
        return rows
    if n >= 0:
        return rows.orderBy("pos").limit(n)
    last = rows.select("pos").orderBy(F.desc("pos")).limit(-n).select(F.min("pos").alias("__from"))
    return rows.join(F.broadcast(last)).where("pos < __from").drop("__from")


def select_tasks(tasks: DataFrame, wanted: list[str], n: int | None = None) -> DataFrame:
    """Tasks in the order of the request; an unknown one is an error."""
    spark = tasks.sparkSession
    asked = F.broadcast(spark.createDataFrame(list(enumerate(wanted)), "pos long, task_id string"))
    known = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unknown task: "), F.col("task_id"))).cast("string")).otherwise(F.col("task_id"))
    found = asked.join(tasks.withColumn("__known", F.lit(True)), "task_id", "left").withColumn("task_id", known).drop("__known")
    return slice_limit(found, n).orderBy("pos")


def numbered(rows: DataFrame, name: str, pos: str = "pos") -> DataFrame:
    """rows (staged in order) with their position from 0. Sorted ranges are numbered apart and put behind each other; no task sorts all rows."""
    ordered = rows.orderBy(pos).withColumns({"__part": F.spark_partition_id(), "__nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    ordered = staged(ordered, "numbered")
    sizes = ordered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row per partition
    return ordered.join(before, "__part").withColumn(name, F.col("__before") + F.col("__nth")).drop("__part", "__nth", "__before")


def dedup_pool(pool: DataFrame, *keys: str, text: str = "raw_output") -> DataFrame:
    return pool.groupBy(*keys, text).agg(F.count("*").alias("count"))


def with_first_match(dedup: DataFrame, pool: DataFrame, prompt: F.Column) -> DataFrame:
    """dedup: out, count. The first pool row with the same text, else the task's prompt as decoder input."""
    from .outcomes import first

    side = first(pool.select(F.col("raw_code_output").alias("out"), *(c for c in pool.columns if c != "raw_code_output")), "out").withColumn("__found", F.lit(True))
    joined = dedup.join(side, "out", "left")
    matched = F.coalesce("__found", F.lit(False))
    return joined.withColumns({"matched": matched, "decoder_input": F.when(matched, F.col("decoder_input_description")).otherwise(prompt)}).drop("__found")


def strict_tasks(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """rows with their task's columns; a row of an unknown task is an error once it is evaluated."""
    known = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unknown task: "), F.col("task_id"))).cast("string")).otherwise(F.col("task_id"))
    return rows.join(tasks.withColumn("__known", F.lit(True)), "task_id", "left").withColumn("task_id", known).drop("__known")


def unknown_tasks(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    return rows.join(tasks.select("task_id"), "task_id", "left_anti").groupBy("task_id").agg(F.count("*").alias("row_count"))
