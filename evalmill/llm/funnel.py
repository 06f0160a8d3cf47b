"""Ordered funnels: attempts, each begun by a row of the first kind, and the steps that each of them reaches in time.

Every step is one fill: attempts, at the time of the step they reached last, are put among the client's candidate rows; in the order of time
descending the last candidate that is not null is the earliest one later than the attempt. At equal times attempts stand before candidates
(their tag is 0, that of candidates 1), so "later" is strict. The same window fills the earliest excluded row. This is repeated for each step, with
DataFrame functions alone.

No client is one group. Time is cut into blocks; an attempt stays in the block it began in, and a row goes to its own block and, as a candidate only, to the
one before if it lies within the time limit of the block's begin. So all that an attempt may reach is in its group, all steps use one
shuffle by client and block, and a client with a large share of all rows is spread over as many groups as there are blocks.
Percentiles come from counts of equal times in two levels (which 65,536 microseconds hold the rank, then which time in them), so their groups are
bounded too. Nothing that grows with the input reaches the driver, one task or a broadcast; the numbers of clients per funnel and depth
(as many rows as there are steps in all funnels) are broadcast.

Edge cases. Rows with a null client, kind or time are left out; repeated rows count once; rows of unknown kinds change nothing. A client without a row of the
first kind has no row. A candidate at the same time as the step before is not later; an excluded row at the same time as the
next step ends the attempt, one at the time of the step before doesn't. An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Blocks of time are so many limits long: a row is dealt 1 + 1 / BLOCKS times on average.
BLOCKS = 4
#: Microseconds (as a power of two) of the ranges in which times are counted first.
RANGE_BITS = 16


@dataclass(frozen=True)
class Funnel:
    """Kinds of rows in the order of the steps, and the kind that ends an attempt between two of them."""

    name: str
    steps: tuple[str, ...]
    excluded: str | None = None


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time; one without a zone is taken as it reads, whatever the zone of the session."""
    t = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(t.cast("timestamp"))
    seconds = F.unix_date(F.to_date(t)).cast("long") * 86_400 + F.hour(t) * 3600 + F.minute(t) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")


def attempts(rows: DataFrame, funnels: list[Funnel], within_us: int, blocks: int = BLOCKS) -> DataFrame:
    """rows: client_id, kind, us. One row per funnel and attempt: funnel, client_id, t1 to tN (microseconds; null where a step isn't reached)."""
    width, most = blocks * within_us, max(len(f.steps) for f in funnels)
    once = rows.dropna(subset=["client_id", "kind", "us"]).select("client_id", "kind", "us").distinct()
    once = once.withColumn("own", F.expr(f"(us - pmod(us, {width})) div {width}"))
    early = F.col("us") - F.col("own") * width < within_us
    dealt = once.select("client_id", "kind", "us", "own", F.explode(F.when(early, F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array("own"))).alias("block")).repartition("client_id", "block")
    known = F.array(*(F.struct(F.lit(f.name).alias("name"), F.array(*map(F.lit, f.steps)).alias("steps"), F.lit(f.excluded).cast("string").alias("excluded")) for f in funnels))
    each = dealt.withColumn("f", F.explode(known))
    step = lambda k: F.coalesce(F.col("kind") == F.get("f.steps", F.lit(k - 1)), F.lit(False))
    starts = step(1) & (F.col("block") == F.col("own"))
    plays = F.coalesce(F.col("kind") == F.col("f.excluded"), F.lit(False))
    for k in range(2, most + 1):
        plays = plays | step(k)
    # tag 0: an attempt, 1: a candidate; a row may be both
    both = each.select("client_id", "block", "us", "kind", "f", F.explode(F.filter(F.array(F.when(starts, 0), F.when(plays, 1)), lambda x: x.isNotNull())).alias("tag"))
    try_ = F.col("tag") == 0
    now = both.select(
        F.col("f.name").alias("funnel"), "client_id", "block", "tag", F.col("us").alias("at"), *(F.when(F.col("tag") == 1, step(k)).alias(f"is{k}") for k in range(2, most + 1)),
        F.when(F.col("tag") == 1, F.col("kind") == F.col("f.excluded")).alias("ends"), F.when(try_, F.col("us")).alias("t1"),
    )
    later = Window.partitionBy("funnel", "client_id", "block").orderBy(F.col("at").desc(), "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(2, most + 1):
        now = now.withColumns({"next": F.last(F.when(F.col(f"is{k}"), F.col("at")), True).over(later), "end": F.last(F.when(F.col("ends"), F.col("at")), True).over(later)})
        reached = F.col(f"t{k - 1}").isNotNull() & (F.col("next") <= F.col("t1") + within_us) & F.coalesce(F.col("end") > F.col("next"), F.lit(True))
        now = now.withColumn(f"t{k}", F.when(try_ & reached, F.col("next"))).withColumn("at", F.coalesce(f"t{k}", "at")).drop("next", "end", f"is{k}")
    return now.where(try_).select("funnel", "client_id", *(f"t{k}" for k in range(1, most + 1)))


def times(tried: DataFrame, steps: int) -> DataFrame:
    """funnel, client_id, step, us (from the step before; 0 for the first), c: how many attempts took so long."""
    each = [F.struct(F.lit(k).alias("step"), (F.col(f"t{k}") - F.col(f"t{k - 1}") if k > 1 else F.col("t1") - F.col("t1")).alias("us")) for k in range(1, steps + 1)]
    rows = tried.select("funnel", "client_id", F.explode(F.filter(F.array(*each), lambda x: x["us"].isNotNull())).alias("x"))
    return rows.groupBy("funnel", "client_id", F.col("x.step").alias("step"), F.col("x.us").alias("us")).agg(F.count("*").alias("c"))


def ranked(counts: DataFrame, percent: int) -> DataFrame:
    """counts: what times() gives. Per funnel, client and step: n, and the ceil(percent * n / 100)-th smallest us."""
    keys = ["funnel", "client_id", "step"]
    counts = counts.withColumn("range", F.shiftright("us", RANGE_BITS))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = counts.groupBy(*keys, "range").agg(F.sum("c").alias("c")).withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    ranges = ranges.withColumn("rank", F.expr(f"({percent} * n + 99) div 100"))
    held = ranges.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c"))).select(*keys, "range", "n", (F.col("rank") - F.col("upto") + F.col("c")).alias("rest"))
    within = whole.orderBy("us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.join(held, [*keys, "range"]).withColumn("upto", F.sum("c").over(within))
    return rows.where(F.col("upto") >= F.col("rest")).groupBy(*keys).agg(F.max("n").alias("n"), F.min("us").alias("us"))


def counted(rows: DataFrame, funnels: list[Funnel], within_us: int, percent: int = 90, blocks: int = BLOCKS) -> DataFrame:
    """rows: client_id, kind, us. Per funnel and client with attempts: funnel, client_id, n1 to nN, deepest, t2 to tN (the percentile of the
    microseconds from the step before, null if no attempt reached the step), same_depth (clients of equal funnel and deepest)."""
    steps = max(len(f.steps) for f in funnels)
    counts = staged(times(attempts(rows, funnels, within_us, blocks), steps), "funnel-times")
    depths = counts.groupBy("funnel", "client_id").agg(F.max("step").alias("deepest")).groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))
    at = lambda k, c: F.max(F.when(F.col("step") == k, F.col(c)))
    out = ranked(counts, percent).groupBy("funnel", "client_id").agg(
        *(F.coalesce(at(k, "n"), F.lit(0)).alias(f"n{k}") for k in range(1, steps + 1)), F.max("step").alias("deepest"), *(at(k, "us").alias(f"t{k}") for k in range(2, steps + 1))
    )
    return out.join(F.broadcast(depths), ["funnel", "deepest"]).select("funnel", "client_id", *(f"n{k}" for k in range(1, steps + 1)), "deepest", *(f"t{k}" for k in range(2, steps + 1)), "same_depth")


#: The funnels of the query, and their limit.
FUNNELS = [Funnel("A", ("view", "click", "view", "purchase"), "error"), Funnel("B", ("signup", "view", "click", "purchase"), "error"), Funnel("C", ("click", "click", "purchase", "view"), "signup")]
WITHIN_US = 30 * 60 * 1_000_000


def op12_funnel(spark, sf_dir: str) -> DataFrame:
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    return counted(clicks.select("client_id", "kind", micros(clicks, "arrived_at").alias("us")), FUNNELS, WITHIN_US)


def _step_sql(k: int) -> str:
    return f"""a{k} AS (
  SELECT a.*, CASE WHEN n.us <= a.t1 + {WITHIN_US} AND NOT coalesce(x.us <= n.us, FALSE) THEN n.us END AS t{k}
  FROM a{k - 1} a ASOF LEFT JOIN e n ON a.client_id = n.client_id AND a.s{k} = n.kind AND a.t{k - 1} < n.us ASOF LEFT JOIN e x ON a.client_id = x.client_id AND a.x = x.kind AND a.t{k - 1} < x.us)"""


OP12_SQL = f"""
WITH e AS (SELECT DISTINCT client_id, kind, epoch_us(arrived_at) AS us FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL),
f(funnel, s1, s2, s3, s4, x) AS (VALUES {", ".join(f"({', '.join(repr(v) for v in (f.name, *f.steps, f.excluded))})" for f in FUNNELS)}),
a1 AS (SELECT f.*, e.client_id, e.us AS t1 FROM e JOIN f ON e.kind = f.s1),
{", ".join(_step_sql(k) for k in (2, 3, 4))},
g AS (SELECT funnel, client_id, count(*) AS n1, count(t2) AS n2, count(t3) AS n3, count(t4) AS n4,
  list_sort(list(t2 - t1) FILTER (t2 IS NOT NULL)) AS d2, list_sort(list(t3 - t2) FILTER (t3 IS NOT NULL)) AS d3, list_sort(list(t4 - t3) FILTER (t4 IS NOT NULL)) AS d4 FROM a4 GROUP BY ALL),
d AS (SELECT *, CAST(CASE WHEN n4 > 0 THEN 4 WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 ELSE 1 END AS INTEGER) AS deepest FROM g)
SELECT funnel, client_id, n1, n2, n3, n4, deepest, d2[(90 * n2 + 99) // 100] AS t2, d3[(90 * n3 + 99) // 100] AS t3, d4[(90 * n4 + 99) // 100] AS t4, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM d
"""
