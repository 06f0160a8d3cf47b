"""The manifest against a plain tree: groups of every awkward size, null groups and ids, repeated rows; proofs that hold and proofs that must not."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from evalmill.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(nodes):
    """The top node, and for every leaf what stands left and right of its path, level by level."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, at):
            run = i // 16 * 16
            way.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
        nodes, at = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], [i // 16 for i in at]
    return nodes[0], ways


def expected(rows):
    groups = {}
    for g, i, leaf, other in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, leaf, other or "", (i, leaf, other)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain([x[2] for x in sorted(groups[g])]) for g in names]
    root, above = plain([t[0] for t in trees])
    return sorted((repr((*x[4], sub, root, way + up)) for g, (sub, ways), up in zip(names, trees, above) for x, way in zip(sorted(groups[g]), ways)))


def made(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows = [(g, rng.choice((None, k, k, k, -k)), h(g or "", str(rng.randrange(10**9))), h("o", str(k)) if k % 5 == 0 else None) for g, n in sizes.items() for k in range(n)]
    rows += rows[:3]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "grp string, id long, leaf string, other string").repartition(7)


SIZES = {None: 5, "": 1, "a": 16, "ab": 17, "é": 256, "z": 257, "Z": 300, "日": 1, "one large group": 1100, **{f"g{k}": 1 + k % 3 for k in range(20)}}


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_equals_a_plain_tree(spark, levels):
    rows, frame = made(spark, SIZES)
    got = merkle.manifest(frame, levels).withColumn("root_again", merkle.folded(F.col("leaf"), F.col("proof"))).withColumn("d", merkle.proof_digest(F.col("proof"))).collect()
    assert sorted(repr((r.id, r.leaf, r.other, r.subroot, r.root, [tuple(x) for x in r.proof])) for r in got) == expected(rows)
    assert all(r.root_again == r.root and r.d == h(*(a + b for a, b in r.proof)) for r in got)


def test_more_than_one_block(spark):
    rows, frame = made(spark, {"a": 4096 + 17, "b": 4096}, 2)
    assert sorted(repr((r.id, r.leaf, r.other, r.subroot, r.root, [tuple(x) for x in r.proof])) for r in merkle.manifest(frame).collect()) == expected(rows)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 3000, 4096])
def test_traversal(n):
    """Paths of a block; what a task holds beside its leaves doesn't grow with them."""
    leaves = [h(str(k)) for k in range(n)]
    levels = next(k for k in range(9) if 16**k >= n)
    assert list(merkle.traversed(leaves, levels)) == plain(leaves)[1]
    desired = merkle.Growing(2)
    most = 0
    for x in leaves:
        desired.add(x)
        most = max(most, sum(map(len, desired.runs)))
    assert most <= 16 * 3


def test_few_rows(spark):
    rows, frame = made(spark, {"a": 1})
    one = frame.limit(1).collect()[0]
    r = merkle.manifest(spark.createDataFrame([one], frame.schema)).first()
    assert r.subroot == r.root == r.leaf and r.proof == []
    assert merkle.manifest(frame.limit(0)).count() == 0


def test_leaves(spark):
    rows = [(1, None, "", "Ä B"), (None, "s", None, None), (-12, "é", "日本", "")]
    got = spark.createDataFrame(rows, "a long, b string, c string, d string").select(merkle.leaf(*map(F.col, "abcd")).alias("h")).collect()
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    assert [r.h for r in got] == [h(*map(part, row)) for row in rows]
    n = [1, 2, 16, 17, 256, 257, 4096, 4097, 16**5, 16**5 + 1, 2**63 - 1]
    levels = spark.createDataFrame([(x,) for x in n], "n long").select(merkle.levels_of(F.col("n")).alias("k")).collect()
    assert [r.k for r in levels] == [next(k for k in range(20) if 16**k >= x) for x in n]


def test_tampered_texts_are_found(spark):
    """Only texts that tampering changes fail; those without a letter in upper case, and null, hold."""
    got = {r.doc_id: r for r in merkle.op13_merkle(spark, "/root/testdata/sf0.001").collect()}
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    bad = {i for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in t or "")}
    assert bad and {i for i, r in got.items() if not r.verified} == bad and len(got) == len(texts)
