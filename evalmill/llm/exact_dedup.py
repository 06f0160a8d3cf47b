"""Exact dedup over an extendible-hash index on shared files.

The 64-bit hashes of texts are cut into ranges, one for each owner. There are so many owners that the texts of one
have OWNER_BYTES on average, whatever the input, and an owner is what one task holds at a time.

1. Map tasks collapse equal texts of a bounded window of rows, so that a text which a third of all rows
   share leaves each task a few times, not once per row.
2. An owner puts each entry into its extendible-hash directory: the first bits of the key behind the owner's range give
   the slot, the slot gives the bucket, and in the bucket the bytes of entries with the same hash are compared:
   an equal text is added up, a different one is chained. An overfull bucket splits, and the directory doubles when
   the bucket's local depth has reached the global depth.
3. Directories and buckets are written to the shared folder (the index): of each owner one row with the slots, and for every
   distinct text an entry with its bucket, hash, length, SHA-256, the row that stays and the number of rows.
4. Rows are dealt to the owners by their hashes. An owner reads its directory and its buckets again and looks up each
   row through them: slot, bucket, hash, then length and SHA-256. Owners with many rows (say, of one text that a third of all rows share) are
   read by several tasks, each with its own share of the rows.

Edge cases. Null text counts as empty. Rows with a null id take part; a group of null ids only has a null
keep_id. Of rows that repeat both the largest id and the text of a group, exactly one is kept. An empty table gives no rows;
columns other than the id and the text are never read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, own_name, parts_for, small_side, staged, text_bytes, texts_of, whole_text, without

#: Entries of a bucket before it splits, and the depth at which it stays overfull instead.
BUCKET_ENTRIES, MOST_DEPTH = 512, 20
#: Bytes of distinct texts that a map task keeps before it passes them on.
COLLAPSE_BYTES = 32 << 20
#: Bytes of text to an owner, and owners to a task.
OWNER_BYTES, OWNERS_PER_TASK = 16 << 20, 4
#: Rows that one task looks up at an owner, unless the average owner has a quarter of that.
LOOKUP_ROWS = 1 << 10

ENTRY = "owner int, h bigint, text binary, max_id bigint, at_max bigint, rows bigint"
#: kind 0: an owner's directory (slots: bucket numbers as 32-bit integers); kind 1: an entry of a bucket.
INDEX = "owner int, kind int, depth int, slots binary, bucket int, chain int, h bigint, n_bytes bigint, sha string, keep_id bigint, keep_rows bigint, group_size bigint, owner_rows bigint"
FOUND = "id bigint, rk bigint, n_bytes bigint, h bigint, sha string, keep_id bigint, keep_rows bigint, group_size bigint"


class Directory:
    """Extendible hashing over the bits of a key that follow the owner's range, most significant first."""

    def __init__(self, capacity: int = BUCKET_ENTRIES):
        self.capacity, self.depth = capacity, 0
        self.slots: list[list] = [[0, "", []]]  # a bucket: local depth, prefix, entries (key, value)

    def bucket(self, key: int) -> list:
        return self.slots[key >> (64 - self.depth) if self.depth else 0]

    def insert(self, key: int, value: object) -> None:
        bucket = self.bucket(key)
        bucket[2].append((key, value))
        while len(bucket[2]) > self.capacity and bucket[0] < MOST_DEPTH and len({k for k, _ in bucket[2]}) > 1:
            if bucket[0] == self.depth:
                self.slots = [b for b in self.slots for _ in (0, 1)]
                self.depth += 1
            self._split(bucket)
            bucket = self.bucket(key)

    def _split(self, bucket: list) -> None:
        local, prefix, entries = bucket
        halves = [[local + 1, prefix + bit, []] for bit in "01"]
        for k, v in entries:
            halves[k >> (63 - local) & 1][2].append((k, v))
        width = 1 << (self.depth - local)
        start = int(prefix or "0", 2) * width
        for i in range(width):
            self.slots[start + i] = halves[i >= width // 2]

    def lookup(self, key: int) -> list:
        return [v for k, v in self.bucket(key)[2] if k == key]

    def buckets(self) -> Iterator[list]:
        last = None
        for b in self.slots:
            if b is not last:
                yield b
            last = b


def owner_key(h: int, owners: int) -> tuple[int, int]:
    """The owner of a signed hash, and the 64 bits of the key behind the owner's range."""
    scaled = (h + (1 << 63)) * owners
    return scaled >> 64, scaled & ((1 << 64) - 1)


def _owners_of(h: np.ndarray, owners: int) -> np.ndarray:
    """Of many hashes, for fewer than 2^31 owners: the upper half of the product, by halves of the hash."""
    u = h.view(np.uint64) ^ np.uint64(1 << 63)
    low = (u & np.uint64(0xFFFFFFFF)) * np.uint64(owners) >> np.uint64(32)
    return ((u >> np.uint64(32)) * np.uint64(owners) + low >> np.uint64(32)).astype(np.int32)


def _owner_column(h: Column, owners: int) -> Column:
    u = h.bitwiseXOR(F.lit(-(1 << 63)))
    low = F.shiftrightunsigned(u.bitwiseAND(F.lit(0xFFFFFFFF)) * owners, 32)
    return F.shiftrightunsigned(F.shiftrightunsigned(u, 32) * owners + low, 32).cast("int")


def _collapse(owners: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            for i, h, t in zip(batch["id"].to_pylist(), batch["h"].to_pylist(), texts_of(batch["text"])):
                e = held.get(t)  # a dict compares the bytes
                if e is None:
                    held[t] = [h, i, 1, 1]
                    size += len(t) + 200
                else:
                    e[3] += 1
                    if e[1] is None or i is not None and i > e[1]:
                        e[1], e[2] = i, 1
                    elif i == e[1]:
                        e[2] += 1
            if size > COLLAPSE_BYTES:
                yield from _entries(held, owners)
                held, size = {}, 0
        yield from _entries(held, owners)

    return f


def _entries(held: dict[bytes, list], owners: int) -> Iterator[pa.RecordBatch]:
    items = list(held.items())
    for k in range(0, len(items), 500):
        part = items[k : k + 500]
        h = np.array([e[0] for _, e in part], np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(_owners_of(h, owners)),
                pa.array(h),
                pa.array([t for t, _ in part], pa.binary()),
                pa.array([e[1] for _, e in part], pa.int64()),
                pa.array([e[2] for _, e in part], pa.int64()),
                pa.array([e[3] for _, e in part], pa.int64()),
            ],
            ["owner", "h", "text", "max_id", "at_max", "rows"],
        )


def _own(owners: int, capacity: int):
    """Entries sorted by owner: each owner's directory and buckets."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, directory = None, Directory(capacity)
        for batch in batches:
            for o, h, t, i, same, rows in zip(*(batch[c].to_pylist() for c in ("owner", "h", "text", "max_id", "at_max", "rows"))):
                if o != owner:
                    if owner is not None:
                        yield from _written(owner, directory)
                    owner, directory = o, Directory(capacity)
                key = owner_key(h, owners)[1]
                for e in directory.lookup(key):  # a value: hash, text, largest id, its rows, all rows
                    if e[0] == h and e[1] == t:
                        e[4] += rows
                        if e[2] is None or i is not None and i > e[2]:
                            e[2], e[3] = i, same
                        elif i == e[2]:
                            e[3] += same
                        break
                else:
                    directory.insert(key, [h, t, i, same, rows])
        if owner is not None:
            yield from _written(owner, directory)

    return f


def _written(owner: int, directory: Directory) -> Iterator[pa.RecordBatch]:
    number, rows, all_rows = {}, [], 0
    for n, bucket in enumerate(directory.buckets()):
        number[id(bucket)] = n
        chain: dict[int, int] = {}
        for k, (h, t, i, same, count) in bucket[2]:
            at = chain[k] = chain.get(k, -1) + 1
            rows.append((owner, 1, None, None, n, at, h, len(t), hashlib.sha256(t).hexdigest(), i, same, count, None))
            all_rows += count
    slots = np.array([number[id(b)] for b in directory.slots], np.int32).tobytes()
    rows.append((owner, 0, directory.depth, slots, None, None, None, None, None, None, None, None, all_rows))
    names, kinds = zip(*(c.split() for c in INDEX.split(", ")))
    arrow = {"int": pa.int32(), "string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    for k in range(0, len(rows), 5000):
        yield pa.RecordBatch.from_arrays([pa.array(x, arrow[kind]) for x, kind in zip(zip(*rows[k : k + 5000]), kinds)], names)


class Index:
    """The written index, its owners, and the owners with so many rows that several tasks look them up (owner, copies)."""

    def __init__(self, rows: DataFrame, owners: int, lookup_rows: int | None = None):
        self.rows, self.owners = rows, owners
        heads = rows.where("kind = 0").select("owner", "owner_rows")
        mean = heads.agg(F.coalesce(F.avg("owner_rows"), F.lit(0.0))).first()[0]
        each = max(LOOKUP_ROWS if lookup_rows is None else lookup_rows, int(4 * mean))
        self.hot = staged(heads.where(F.col("owner_rows") > each).select("owner", F.ceil(F.col("owner_rows") / each).cast("int").alias("copies")), "hot-owners")

    def entries(self) -> DataFrame:
        return self.rows.where("kind = 1")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES, owner_bytes: int = OWNER_BYTES, lookup_rows: int | None = None) -> Index:
    """The index as written to the shared folder."""
    spark = docs.sparkSession
    owners = parts_for(spark, text_bytes(docs, text_col), owner_bytes, OWNERS_PER_TASK)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    entries = map_batches(rows, _collapse(owners), ENTRY)
    dealt = entries.repartition(-(-owners // OWNERS_PER_TASK), "owner").sortWithinPartitions("owner")
    return Index(staged(map_batches(dealt, _own(owners, capacity), INDEX), "exact-index"), owners, lookup_rows)


def _look_up(owners: int):
    """Rows sorted by owner, copy, kind: an owner's directory, its buckets, and the rows that are looked up through them."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth, slots, buckets = 0, np.zeros(1, np.int32), {}
        for batch in batches:
            c = {k: batch[k].to_pylist() for k in ("kind", "depth", "slots", "bucket", "h", "n_bytes", "sha", "keep_id", "keep_rows", "group_size", "id", "rk")}
            out = []
            for k, kind in enumerate(c["kind"]):
                if kind == 0:
                    depth, slots, buckets = c["depth"][k], np.frombuffer(c["slots"][k], np.int32), {}
                elif kind == 1:
                    buckets.setdefault(c["bucket"][k], {}).setdefault(c["h"][k], []).append((c["n_bytes"][k], c["sha"][k], c["keep_id"][k], c["keep_rows"][k], c["group_size"][k]))
                else:
                    h, n, sha = c["h"][k], c["n_bytes"][k], c["sha"][k]
                    bucket = buckets[int(slots[owner_key(h, owners)[1] >> (64 - depth) if depth else 0])]
                    out.append((c["id"][k], c["rk"][k], n, h, sha, *next(e[2:] for e in bucket[h] if e[0] == n and e[1] == sha)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in FOUND.split(", ")])

    return f


def look_up(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, rk (common.row_key of id and text, null as empty), n_bytes, h, sha, and what the index says of its text: keep_id, keep_rows, group_size."""
    owners, spark = index.owners, docs.sparkSession
    hot = small_side(index.hot)
    thin = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).select("id", F.xxhash64("id", "text").alias("rk"), F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("sha"))
    thin = thin.withColumn("owner", _owner_column(F.col("h"), owners)).join(hot, "owner", "left")
    nth = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.coalesce("copies", F.lit(1)).cast("long"))  # any share will do
    rows = thin.withColumns({"copy": nth.cast("int"), "kind": F.lit(2)}).drop("copies")
    there = index.rows.drop("chain", "owner_rows").join(hot, "owner", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    dealt = there.unionByName(rows, allowMissingColumns=True).repartition(-(-owners // OWNERS_PER_TASK), "owner", "copy").sortWithinPartitions("owner", "copy", "kind")
    return map_batches(dealt, _look_up(owners), FOUND)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET_ENTRIES, owner_bytes: int = OWNER_BYTES, lookup_rows: int | None = None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256."""
    index = build_index(docs, id_col, text_col, capacity, owner_bytes, lookup_rows)
    found = look_up(docs, index, id_col, text_col)
    at_keep = F.col("id").eqNullSafe(F.col("keep_id"))
    if index.entries().where("keep_rows > 1").isEmpty():
        found = found.withColumn("kept", at_keep)
    else:  # some rows repeat id and text: the first written of them stays
        found = staged(found.withColumn("nth", F.monotonically_increasing_id()), "looked-up")
        first = staged(found.where(at_keep & (F.col("keep_rows") > 1)).groupBy("h", "sha").agg(F.min("nth").alias("first")), "repeated-rows")
        found = found.join(small_side(first), ["h", "sha"], "left").withColumn("kept", at_keep & F.coalesce(F.col("nth") == F.col("first"), F.lit(True)))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Edge cases as above; of rows that repeat the id that stays and its text, one is kept, whatever its other columns.
    """
    index = build_index(docs, id_col, text_col)
    gone = look_up(docs, index, id_col, text_col).where(~F.col("id").eqNullSafe(F.col("keep_id")))
    kept, text = without(docs, gone.select("rk", "h"), id_col, text_col), whole_text(text_col)
    if index.entries().where("keep_rows > 1").isEmpty():
        return kept
    h, i, k = own_name("h"), own_name("id"), own_name("key")
    again = staged(index.entries().where("keep_rows > 1").select(F.col("h").alias(h), F.col("keep_id").alias(i)), "repeated-rows")
    repeated = (F.xxhash64(text) == F.col(h)) & F.col(id_col).cast("long").eqNullSafe(F.col(i))
    side = small_side(again)
    one = kept.join(side, repeated, "left_semi").withColumn(k, F.struct(F.col(id_col).cast("long"), text)).dropDuplicates([k]).drop(k)
    return kept.join(side, repeated, "left_anti").unionByName(one)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
