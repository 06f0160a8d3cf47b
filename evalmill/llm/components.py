"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Links up to which one task finds the components; steps over tables find those of more, with the same result.
TASK_LINKS = 1 << 19


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find: node, label, the least node of its component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for k in range(0, len(nodes), 100_000):
        some = nodes[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["node", "label"])


def components(links: DataFrame, task_links: int | None = None) -> DataFrame:
    """links: u, v (long). One row per linked node: node, label, the least node of its component.

    Every step is a pair of thin shuffles over the links that are left; nothing is collected but a count and a checksum of the written links.
    """
    first = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = staged(first, "links")
    if edges.count() <= (TASK_LINKS if task_links is None else task_links):
        return edges.coalesce(1).mapInArrow(_in_one_task, "node bigint, label bigint")
    before = None
    while True:
        # large-star: every larger neighbour of a node points to the node's least neighbour (or the node itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: a node and its smaller neighbours point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = staged(small, "links")
        h = F.xxhash64("u", "v")
        now = tuple(new.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())
        if now == before:  # no step changes the links any more
            return new.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        edges, before = new, now


def merged(member: DataFrame, links: DataFrame, task_links: int | None = None) -> DataFrame:
    """member (fp, label, and more) after more links (u, v: of fp): only links between components, by their labels, are looked at. Every label is the least fp of its component."""
    lu, lv = (member.select(F.col("fp").alias(c), F.col("label").alias(f"l{c}")) for c in "uv")
    between = links.join(lu, "u").join(lv, "v").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
    new = components(between, task_links).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return staged(member.join(new, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to").select(*member.columns), "members")
