"""A Merkle manifest of a dataset: a digest for every row, group and the whole, and for every row the proof that it belongs there.

H is the lower-case hexadecimal SHA-256 of its inputs put together, digests as hexadecimal text. Leaves are the rows' digests, in each
group (source) in the order of their ids. While several nodes remain, every 16 consecutive ones become their H (the last run may have fewer, even
one). What remains is the group's subroot; subroots in the order of the groups (null first, by bytes) become the root likewise.

Leaves are placed by one sort in ranges over all tasks; a leaf's place in its group is its place in its task less where its group begins
there, plus what tasks before hold of the group (a table of a row per task and group). So a group with a large share of all rows is as many tasks as it needs.
Nodes are aggregated level by level, 16 to 1. A block is 4096 consecutive leaves of a group, aligned, and its node stands three levels up. The proofs of
blocks are found from the root downwards by joins, level by level; they are as few as blocks.

Proofs within a block are made by fractal traversal. A stack of subtrees, one per level, holds the runs on the path of the present leaf (existing). Beside
each stands the run that comes next on its level (desired), which grows by one leaf with every step, so that it is whole when the path leaves the
existing one and takes its place. The task holds one block of leaves and two runs a level, however many leaves there are, and appends the block's own proof to each.

Edge cases. Of the fields, null is "-", so it differs from an empty text. A null group is a group of its own, the first; null ids come first. Rows that repeat
an id are ordered by their leaves, and rows that are equal are leaves each. A group of one leaf has that as its subroot, and a dataset of one such group
as its root, with an empty proof. An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, rows_of, small_side, staged

#: Nodes of a run, levels of a block, and the levels that 64-bit places may need.
ARITY, LEVELS, MOST_LEVELS = 16, 3, 16

PROOF = "array<struct<left:string,right:string>>"
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# -- columns


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as the bytes it has, a colon and its value; null as a dash."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields)), 256)


def folded(of: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, of, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """H of all siblings, from the leaf's run to the root's, each run from left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda x: F.concat(x["left"], x["right"]))), 256)


def levels_of(n: Column) -> Column:
    """Levels above n leaves: how often 16 become one until one remains."""
    out = F.lit(MOST_LEVELS)
    for k in range(MOST_LEVELS - 1, -1, -1):
        out = F.when(n <= min(ARITY**k, 2**63 - 1), k).otherwise(out)
    return out


# -- the tree


def placed(leaves: DataFrame, *order: str) -> DataFrame:
    """leaves (grp, not null, and more) with place (0, 1, ... within grp in the given order) and n, the group's leaves."""
    at = leaves.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id())
    at = staged(at.withColumns({"task": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)}), "merkle-places")
    parts = at.groupBy("grp", "task").agg(F.count("*").alias("c"), F.min("at").alias("begin"))
    own = Window.partitionBy("grp")  # a row per task that holds some of the group
    before = F.coalesce(F.sum("c").over(own.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = staged(parts.select("grp", "task", (before - F.col("begin")).alias("shift"), F.sum("c").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n")), "merkle-shifts")
    return at.join(small_side(shift), ["grp", "task"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "shift", "task")


def raised(nodes: DataFrame, level: int) -> DataFrame:
    """nodes (grp, place, h, n: leaves of the group) of a level to those of the next one; a group of one node stays as it is."""
    run = F.array_sort(F.collect_list(F.struct("place", "h")))  # 16 at most
    up = nodes.groupBy("grp", "n", F.expr(f"place div {ARITY}").alias("place")).agg(run.alias("run"))
    text = F.concat_ws("", F.transform("run", lambda x: x["h"]))
    return up.select("grp", "place", "n", F.when(levels_of(F.col("n")) > level, F.sha2(text, 256)).otherwise(F.col("run")[0]["h"]).alias("h"))


def tree(nodes: DataFrame, level: int, name: str) -> list[DataFrame]:
    """All levels from this one to that in which every group has one node, each as a table."""
    most = nodes.agg(F.max(levels_of(F.col("n")))).first()[0] or 0
    out = [nodes]
    while level + len(out) - 1 < most:
        out.append(staged(raised(out[-1], level + len(out) - 1), name))
    return out


def proven(levels: list[DataFrame], level: int, top: DataFrame) -> DataFrame:
    """The nodes of the lowest of the levels with their proofs up to the root. top: grp, proof of each group's last node."""
    proofs = levels[-1].join(small_side(top), "grp").select("grp", "place", "proof")
    for k in range(len(levels) - 2, -1, -1):
        run = levels[k].groupBy("grp", "n", F.expr(f"place div {ARITY}").alias("up")).agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("run"))
        text = lambda a, n: F.concat_ws("", F.transform(F.slice("run", a, n), lambda x: x["h"]))
        each = run.select("grp", "n", "up", "run", F.posexplode("run").alias("i", "node"))
        each = each.select("grp", "up", F.col("node.place").alias("place"), (levels_of(F.col("n")) > level + k).alias("inner"), F.struct(text(1, F.col("i")).alias("left"), text(F.col("i") + 2, ARITY).alias("right")).alias("own"))
        above = proofs.select("grp", F.col("place").alias("up"), "proof")
        proofs = each.join(above, ["grp", "up"]).select("grp", "place", F.when(F.col("inner"), F.concat(F.array("own"), "proof")).otherwise(F.col("proof")).alias("proof"))
    return proofs


# -- proofs within blocks


def _h(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Growing:
    """A run of a level that grows leaf by leaf: nodes of the levels below wait until their run is whole."""

    def __init__(self, level: int):
        self.runs: list[list[str]] = [[] for _ in range(level + 1)]

    def add(self, leaf: str) -> None:
        self.runs[0].append(leaf)
        for k in range(len(self.runs) - 1):
            if len(self.runs[k]) < ARITY:
                return
            self.runs[k + 1].append(_h(self.runs[k]))
            self.runs[k] = []

    def closed(self) -> list[str]:
        """The run; what waits below is a last run of fewer nodes."""
        for k in range(len(self.runs) - 1):
            if self.runs[k]:
                self.runs[k + 1].append(_h(self.runs[k]))
                self.runs[k] = []
        return self.runs[-1]


def traversed(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a block in order, what stands left and right of its path on each level."""
    existing = []
    for k in range(levels):
        first = Growing(k)
        for x in leaves[: ARITY ** (k + 1)]:
            first.add(x)
        existing.append(first.closed())
    desired = [Growing(k) for k in range(levels)]
    path: list[tuple[str, str]] = [("", "")] * levels
    for i in range(len(leaves)):
        for k in range(levels):
            if i and i % ARITY ** (k + 1) == 0:
                existing[k], desired[k] = desired[k].closed(), Growing(k)
            if i % ARITY**k == 0:
                at = i // ARITY**k % ARITY
                path[k] = "".join(existing[k][:at]), "".join(existing[k][at + 1 :])
        yield list(path)
        for k in range(levels - 1):  # the run of the last level is that of the whole block
            if i + ARITY ** (k + 1) < len(leaves):
                desired[k].add(leaves[i + ARITY ** (k + 1)])


def _proofs(block_levels: int):
    """Rows sorted by block and place, before each block's leaves a row (place -1) with its own proof; a proof for each leaf."""
    struct = pa.struct([("left", pa.string()), ("right", pa.string())])
    names = ["id", "leaf", "other", "subroot", "root", "proof"]

    def block(head: dict, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        above = [(x["left"], x["right"]) for x in head["proof"]]
        paths = traversed([r[1] for r in rows], min(block_levels, head["levels"]))
        for k in range(0, len(rows), 256):
            some = rows[k : k + 256]
            proofs = [[{"left": a, "right": b} for a, b in next(paths) + above] for _ in some]
            ids, leaves, others = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(leaves), pa.array(others, pa.string()), pa.array([head["subroot"]] * len(some)), pa.array([head["root"]] * len(some)), pa.array(proofs, pa.list_(struct))], names)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, rows = {}, []
        for batch in batches:
            first = [p < 0 for p in batch["place"].to_pylist()]
            heads = rows_of(batch.filter(pa.array(first)))
            for begins, row in zip(first, zip(batch["id"].to_pylist(), batch["leaf"].to_pylist(), batch["other"].to_pylist())):
                if not begins:
                    rows.append(row)
                    continue
                if rows:
                    yield from block(head, rows)
                head, rows = next(heads), []
        if rows:
            yield from block(head, rows)

    return f


def manifest(rows: DataFrame, block_levels: int = LEVELS) -> DataFrame:
    """rows: grp (string), id (long), leaf, other (another leaf to be folded with the proof, or null). Per row: id, leaf, other, subroot, root, proof (per
    level from the leaf's, what stands left and right of its path). A task holds blocks of 16 to the power of block_levels leaves."""
    # a key without nulls that sorts as the groups do
    keyed = rows.select(F.coalesce(F.concat(F.lit("s"), F.col("grp").cast("string")), F.lit("n")).alias("grp"), F.col("id").cast("long").alias("id"), "leaf", "other")
    leaves = placed(staged(keyed, "merkle-leaves"), "id", "leaf", "other")
    nodes = leaves.select("grp", "place", "n", F.col("leaf").alias("h"))
    for k in range(block_levels):
        nodes = raised(nodes, k)
    upper = tree(staged(nodes, "merkle-blocks"), block_levels, "merkle-nodes")
    subroots = upper[-1].select("grp", F.col("h").alias("subroot"), "n")
    # the same above the groups
    top = placed(subroots.select(F.lit("all").alias("grp"), F.col("grp").alias("name"), F.col("subroot").alias("h")), "name")
    tops = tree(staged(top, "merkle-tops"), 0, "merkle-nodes")
    root = F.broadcast(tops[-1].select(F.col("h").alias("root")))  # one row
    start = tops[-1].select("grp", F.lit(None).cast(PROOF).alias("proof")).withColumn("proof", F.coalesce("proof", F.array().cast(PROOF)))
    above = proven([t.select("grp", "place", "n", "h") for t in tops], 0, start).join(tops[0].select("name", "place"), "place").select(F.col("name").alias("grp"), "proof")
    groups = staged(subroots.join(above, "grp").join(root), "merkle-groups")
    heads = proven(upper, block_levels, groups.select("grp", "proof")).join(small_side(groups.select("grp", "subroot", "root", "n")), "grp")
    none = lambda kind: F.lit(None).cast(kind)
    heads = heads.select("grp", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), none("long").alias("id"), none("string").alias("leaf"), none("string").alias("other"), levels_of(F.col("n")).alias("levels"), "subroot", "root", "proof")
    leaves = leaves.select("grp", F.expr(f"place div {ARITY**block_levels}").alias("block"), "place", "id", "leaf", "other", none("int").alias("levels"), none("string").alias("subroot"), none("string").alias("root"), none(PROOF).alias("proof"))
    both = heads.unionByName(leaves).repartition("grp", "block").sortWithinPartitions("grp", "block", "place")
    return map_batches(both.drop("grp", "block"), _proofs(block_levels), f"id bigint, leaf string, other string, subroot string, root string, proof {PROOF}")


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = lambda text: leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars")), text)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, own(F.translate("text", UPPER_CASE, LOWER_CASE)))
    out = manifest(docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), own(F.col("text")).alias("leaf"), tampered.alias("other")))
    out = out.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("proof")))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    parts = (f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(parts)})"


#: CRC-32 bit by bit over the digits of an id: each byte is taken in and shifted out eight times.
_CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
  lambda i: [ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))))"""
_BESIDE_SQL = """*, coalesce(string_agg(h, '') OVER (PARTITION BY grp, lvl, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (PARTITION BY grp, lvl, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"""
_ASCII_LOWER_SQL = f"translate(text, '{UPPER_CASE}', '{LOWER_CASE}')"
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('s' || source, 'n') AS grp, {_leaf_sql("text")} AS leaf, CASE WHEN {_CRC_SQL} % 5 = 0 THEN {_leaf_sql(_ASCII_LOWER_SQL)} END AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM d),
nodes AS (SELECT grp, 0 AS lvl, idx, leaf AS h, n FROM p UNION ALL SELECT grp, lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY grp, lvl, idx // 16, n),
s AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 'all' AS grp, 0 AS lvl, idx, subroot AS h, n FROM s UNION ALL SELECT grp, lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16 FROM tops WHERE n > 1 GROUP BY grp, lvl, idx // 16, n),
steps AS (SELECT grp, lvl, idx, l, r FROM (SELECT {_BESIDE_SQL} FROM nodes WHERE n > 1)),
top_steps AS (SELECT lvl, idx, l, r FROM (SELECT {_BESIDE_SQL} FROM tops WHERE n > 1)),
x AS (SELECT p.doc_id, p.grp, p.idx, p.leaf, coalesce(p.other, p.leaf) AS start, s.subroot, s.idx AS at, (SELECT h FROM tops WHERE n = 1) AS root FROM p JOIN s USING (grp)),
way AS (SELECT x.grp, x.idx, lvl, l, r FROM x JOIN steps t ON x.grp = t.grp AND t.idx = x.idx >> (4 * t.lvl) UNION ALL SELECT x.grp, x.idx, 100 + lvl, l, r FROM x JOIN top_steps t ON t.idx = x.at >> (4 * t.lvl)),
whole AS (SELECT grp, idx, list(l ORDER BY lvl) AS ls, list(r ORDER BY lvl) AS rs, string_agg(l || r, '' ORDER BY lvl) AS siblings, count(*) AS steps FROM way GROUP BY ALL),
fold AS (SELECT x.grp, x.idx, 0 AS step, x.start AS h, ls, rs, coalesce(steps, 0) AS steps FROM x LEFT JOIN whole USING (grp, idx)
  UNION ALL SELECT grp, idx, step + 1, sha256(ls[step + 1] || h || rs[step + 1]), ls, rs, steps FROM fold WHERE step < steps)
SELECT x.doc_id, x.leaf, x.subroot, x.root, sha256(coalesce(w.siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = x.root AS verified
FROM x LEFT JOIN whole w USING (grp, idx) JOIN fold f ON f.grp = x.grp AND f.idx = x.idx AND f.step = f.steps
"""
