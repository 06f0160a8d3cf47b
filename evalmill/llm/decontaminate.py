"""Benchmark decontamination by one Aho-Corasick automaton over the normalised benchmark texts.

Normalising lower-cases A-Z and turns every ASCII byte that is neither letter nor digit into a space, one
byte for one byte; words are what the spaces separate. A pattern is a run of `window` item words between
single spaces. Each document is scanned once; a match's end gives its last word by a count of spaces, and a
word's number gives its place in the original bytes.

The benchmark is a query set and is sent to the tasks only in blocks of at most BLOCK_BYTES of text: the number of
blocks, not their size, grows with the benchmark, every block scans all documents, and the hits of the blocks are
written and united per document. The driver reads the benchmark once and holds one block at a time. One block, the usual case, needs no
shuffle at all. Workers keep the automaton from task to task.

Edge cases. Null and empty texts have no words; items without words have no window and are never found;
repeated items and items that share a window are each found. Windows of an item without an id (null, or not a number) hit, but
such an item is neither counted nor listed. Repeated documents give a row each. Empty tables give no
rows, or rows without hits. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, kept_batches, map_batches, staged, texts_of

WINDOW = 10
BLOCK_BYTES = 8 << 20

#: Byte for byte: letters in lower case, digits and all that is not ASCII as they are, the rest spaces.
NORMAL = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")

SPANS = "id bigint, n_words bigint, hit_words array<int>, items array<bigint>, starts array<bigint>, ends array<bigint>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def patterns(items: list[tuple[int | None, bytes]], window: int) -> dict[str, list[int]]:
    """Every window of every item, as latin-1 text between spaces, and the items that have it."""
    out: dict[str, list[int]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            own = out.setdefault(f" {b' '.join(words[i : i + window]).decode('latin-1')} ", [])
            if item is not None and item not in own:
                own.append(item)
    return out


def automaton(found: dict[str, list[int]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for text, own in found.items():
        a.add_word(text, (text.count(" ") - 1, own))
    a.make_automaton()
    return a


def _automaton_of(shared) -> ahocorasick.Automaton:
    """That of broadcast patterns, built once per worker: a worker has one value for all tasks of a broadcast."""
    own = kept(__name__)
    if own.get("patterns") is not shared.value:
        own.update(patterns=shared.value, automaton=automaton(shared.value))
    return own["automaton"]


def hits(a: ahocorasick.Automaton, text: bytes) -> bool:
    """Does any window occur?"""
    words = text.translate(NORMAL).split()
    return bool(words and len(a) and next(a.iter(f" {b' '.join(words).decode('latin-1')} "), None))


def scan(a: ahocorasick.Automaton, text: bytes) -> tuple[int, np.ndarray, list[int], list[int], list[int]]:
    """Words; numbers of the words that are hit; items; first and last byte (exclusive) of each hit run in the text."""
    normal = text.translate(NORMAL)
    words = normal.split()
    found = list(a.iter(f" {b' '.join(words).decode('latin-1')} ")) if words and len(a) else []
    if not found:
        return len(words), np.empty(0, np.int32), [], [], []
    line = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    spaces = np.cumsum(line == 32)  # at the end of a match: the words before it, and its own
    change = np.zeros(len(words) + 1, np.int64)
    items: set[int] = set()
    for end, (n, own) in found:
        last = int(spaces[end]) - 1
        change[last - n] += 1
        change[last] -= 1
        items.update(own)
    hit = np.flatnonzero(np.cumsum(change)[:-1] > 0).astype(np.int32)
    places = [m.span() for m in WORD.finditer(normal)]
    cut = np.flatnonzero(np.diff(hit) > 1)
    first, last = np.concatenate(([hit[0]], hit[cut + 1])), np.concatenate((hit[cut], [hit[-1]]))
    return len(words), hit, sorted(items), [places[i][0] for i in first], [places[i][1] for i in last]


def _scan_all(shared):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton_of(shared)
        for batch in batches:
            out = [scan(a, t) for t in texts_of(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array([x[0] for x in out], pa.int64())] + [pa.array([x[k] for x in out], kind) for k, kind in ((1, pa.list_(pa.int32())), (2, pa.list_(pa.int64())), (3, pa.list_(pa.int64())), (4, pa.list_(pa.int64())))],
                ["id", "n_words", "hit_words", "items", "starts", "ends"],
            )

    return f


def blocks_of(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of at most block_bytes (or one item); the driver holds one block at a time."""
    block, size = [], 0
    for r in items.select(F.col(item_col).try_cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").distinct().toLocalIterator():
        text = r.t.encode()
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, text))
        size += len(text)
    yield block


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, hit_words (numbers), items, starts and ends (byte spans in the original text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = blocks_of(items, item_col, item_text_col, block_bytes)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return map_batches(rows, _scan_all(spark.sparkContext.broadcast(patterns(block, window))), SPANS)
    # more than one block: each document's hits are put together again, by a number that the row has in every scan
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    united = None
    while block is not None:
        shared = spark.sparkContext.broadcast(patterns(block, window))
        one = map_batches(rows.select(F.col("h").alias("id"), "text"), _scan_all(shared), SPANS).where("size(hit_words) > 0").dropDuplicates(["id"])
        one = staged(one, "block-hits")
        shared.destroy()
        united = one if united is None else united.unionByName(one)
        block, after = after, next(blocks, None)
    merged = united.groupBy("id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_words")))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"),
    ).withColumnRenamed("id", "h")
    counted = rows.select("id", "h", F.size(F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), " "), lambda w: w != "")).cast("long").alias("n_words"))
    none = F.array().cast("array<bigint>")
    return counted.join(merged, "h", "left").select("id", "n_words", F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"), *(F.coalesce(c, none).alias(c) for c in ("items", "starts", "ends")))


def clean_rows(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of any item occurs; each block of items filters what the last one left.

    Edge cases as above: documents without words stay, repeated ones stay or go together, columns may have any names.
    """
    blocks = blocks_of(items, item_col, item_text_col, block_bytes)
    block, after = next(blocks), next(blocks, None)
    while block is not None:
        shared = docs.sparkSession.sparkContext.broadcast(patterns(block, window))

        def keep(shared=shared):
            a = _automaton_of(shared)
            return lambda texts: [not hits(a, t) for t in texts]

        docs = kept_batches(docs, keep, text_col)
        if after is not None:
            docs = staged(docs, "block-clean")
            shared.destroy()
        block, after = after, next(blocks, None)
    return docs


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("id").alias(id_col), "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated")
    )


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return digest(contamination(docs, items))


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, list_slice(w, s, s + least(len(w), {WINDOW}) - 1) AS x
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
p AS (SELECT r, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS x
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM g))),
m AS (SELECT p.r, p.s, p.k, g.item_id FROM p JOIN g ON p.k = g.k AND p.x = array_to_string(g.x, ' ')),
h AS (SELECT r, count(DISTINCT n) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS n FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
