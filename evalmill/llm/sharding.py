"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Rows with equal texts form a group that no shard boundary may cut. A group's weight is the bytes of all its rows.
Differencing works on partial partitions, each a vector of one sum per shard, that wait in a heap by spread; the two with the
largest spread are combined, largest sum onto smallest sum, until one is left. Every group is differenced, but no task or driver holds all of them:

1. The driver differences the groups above 1/ITEMS of all bytes or rows, at most 2 * ITEMS, whatever the input. What they leave open
   gives each shard's quota of the other groups' bytes: less for a shard with a heavy group, or nothing.
2. Tasks difference the other groups, CHUNK at a time. A chunk's heap also holds one partial partition of what each shard is ahead of
   its quota, by all chunks of the task so far, and so an error of one chunk is made good by the next. In the end each shard is as far from its quota
   as there are tasks, times the few bytes by which one chunk misses.

Slots number the rows of a shard without gaps. They come from offsets of sub-bundles (what a shard gets of one of ITEMS hash bundles, or a heavy group,
split by a hash of the id where it holds more than 1/ITEMS of all rows; at most (shards + 3) * ITEMS in all) and a row number
within each, so no task sorts a whole shard or a whole hot group.

Edge cases. Null text has no bytes and groups with the empty text; size is bytes plus 1. Repeated rows are
rows of one group with a slot each. An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, staged, whole_text

#: Hash bundles, and the fraction of bytes or rows above which a group is differenced at the driver; groups that a task differences at once.
ITEMS, CHUNK = 1024, 4096

PLACED = "g binary, bundle int, shard int"


def combined(vectors: list[list[int]], k: int) -> tuple[list[list[int]], list[int]]:
    """k-way Karmarkar-Karp over partial partitions of at most k sums each: the part (0 to k-1) of each of their sums, and the sums of the parts."""
    leaves, heap = [], []
    for n, v in enumerate(vectors):
        order = sorted(range(len(v)), key=v.__getitem__)
        sums, nodes = [0] * (k - len(v)) + [v[j] for j in order], [-1] * (k - len(v)) + [len(leaves) + j for j in order]
        leaves += [(n, j) for j in range(len(v))]
        heap.append((sums[0] - sums[-1], n, [x - sums[0] for x in sums], nodes))
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    fresh = max(len(leaves), len(vectors))
    while len(heap) > 1:
        _, _, a, at = heapq.heappop(heap)
        _, _, b, bt = heapq.heappop(heap)
        pairs = []
        for x, y, s, t in zip(a, reversed(b), at, reversed(bt)):  # ascending against descending
            if s < 0 or t < 0:
                node = max(s, t)
            else:
                node, parent[fresh] = fresh, (s, t)
                fresh += 1
            pairs.append((x + y, node))
        pairs.sort()
        low = pairs[0][0]
        heapq.heappush(heap, (low - pairs[-1][0], fresh, [x - low for x, _ in pairs], [t for _, t in pairs]))
        fresh += 1
    parts, sums = [[0] * len(v) for v in vectors], [0] * k
    for part, root in enumerate(heap[0][3] if heap else []):
        todo = [root] if root >= 0 else []
        while todo:
            node = todo.pop()
            if node < len(leaves):
                n, j = leaves[node]
                parts[n][j] = part
                sums[part] += vectors[n][j]
            else:
                todo += parent[node]
    return parts, sums


def differencing(weights: list[int], k: int) -> list[int]:
    """The part (0 to k-1) of each weight."""
    return [p[0] for p in combined([[w] for w in weights], k)[0]]


def quotas(heavy: list[int], light: int) -> list[int]:
    """How much of the light bytes each shard should get, given the heavy bytes that it has: all up to one level."""
    level, have = 0, 0
    for n, h in enumerate(sorted(heavy), 1):
        have += h
        if n == len(heavy) or n * sorted(heavy)[n] - have >= light:
            level = -(-(light + have) // n)
            break
    return [max(0, level - h) for h in heavy]


def _difference(want: list[int], size: int):
    """Groups, in chunks: the shard of each, so that the shards' sums are in proportion to their quotas."""
    k, total = len(want), max(1, sum(want))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, weights, bundles = [], [], []
        have, seen = [0] * k, 0

        def chunk() -> pa.RecordBatch:
            nonlocal seen
            seen += sum(weights)
            open_ = [q * seen // total - h for q, h in zip(want, have)]
            parts, _ = combined([[max(open_) - x for x in open_], *([w] for w in weights)], k)
            shard_of = {p: j for j, p in enumerate(parts[0])}  # the part that holds a shard's lead is the shard
            found = [shard_of[p[0]] for p in parts[1:]]
            for j, w in zip(found, weights):
                have[j] += w
            return pa.RecordBatch.from_arrays([pa.array(groups, pa.binary()), pa.array(bundles, pa.int32()), pa.array(found, pa.int32())], [c.split()[0] for c in PLACED.split(", ")])

        for batch in batches:
            for g, b, w in zip(*(batch[c].to_pylist() for c in ("g", "bundle", "w"))):
                groups.append(g)
                bundles.append(b)
                weights.append(w)
                if len(groups) == size:
                    yield chunk()
                    groups, weights, bundles = [], [], []
        if groups:
            yield chunk()

    return f


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", items: int = ITEMS, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: id_col, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)."""
    spark = docs.sparkSession
    text = whole_text(text_col)
    thin = staged(docs.select(F.col(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("g")), "shard-sizes")
    groups = thin.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("w")).withColumn("bundle", F.pmod(F.xxhash64("g"), F.lit(items)).cast("int"))
    groups = staged(groups, "shard-groups")
    rows, size = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    is_heavy = (F.col("n") * items > rows) | (F.col("w") * items > size)
    heavy = groups.where(is_heavy).select("g", "n", "w").orderBy("g").collect()  # fewer than 2 * items
    parts, sums = combined([[r.w] for r in heavy], shards)
    placed = staged(map_batches(groups.where(~is_heavy).select("g", "bundle", "w"), _difference(quotas(sums, size - sum(sums)), chunk), PLACED), "shard-placed")

    # a row's item: its group's bundle, or its heavy group; sub: the shard within a bundle, a share of a heavy group's rows
    own = spark.createDataFrame([(bytes(r.g), items + i, max(1, -(-r.n * items // max(rows, 1)))) for i, r in enumerate(heavy)], "g binary, own int, parts long")
    marked = thin.join(F.broadcast(own), "g", "left")
    hot = marked.where("own is not null").select(id_col, "size", "text_crc32", F.col("own").alias("item"), F.pmod(F.xxhash64(F.col(id_col)), F.col("parts")).alias("sub"))
    cold = marked.where("own is null").join(placed, "g").select(id_col, "size", "text_crc32", F.col("bundle").alias("item"), F.col("shard").cast("long").alias("sub"))
    dealt = staged(cold.unionByName(hot), "shard-dealt")
    subs = dealt.groupBy("item", "sub").agg(F.count("*").alias("n")).orderBy("item", "sub").collect()  # at most (shards + 3) * items
    start: dict[int, int] = defaultdict(int)
    places = []
    for r in subs:
        to = parts[r.item - items][0] if r.item >= items else r.sub
        places.append((r.item, r.sub, to, start[to]))
        start[to] += r.n
    place = F.broadcast(spark.createDataFrame(places, "item int, sub long, shard int, first long"))
    nth = F.row_number().over(Window.partitionBy("item", "sub").orderBy(F.col(id_col), "text_crc32")) - 1
    return dealt.join(place, ["item", "sub"]).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + nth).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op1_shard(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
