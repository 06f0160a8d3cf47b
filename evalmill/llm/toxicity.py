"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams (3 to 5 characters of the lower-cased text); a feature's value is the logarithm
of one plus its rate in the text, so long and short texts compare. For the labelled rows, r = log of the
smoothed sum of a feature's values per toxic text over that per other text; a logistic regression with L2
penalty is fitted to the values times r, and weight times r is one number per feature. The model is a vector of BUCKETS floats, whatever the input, and scoring needs no shuffle.

It is fitted on at most SAMPLE_TOXIC toxic and SAMPLE_OTHER other labelled rows, those with the smallest
hashes of the id, whole texts whatever their length; of each label the rows in that order up to SAMPLE_BYTES bytes of text in all (one row at least).

Edge cases. Null text is empty and gets the score of a text without features. Rows with a null label are not
learned from; a label that repeats an id counts again; of documents that repeat an id one text is learned from (that with the least
hash); null ids are never learned from and not held out. Without labels of both
kinds every score is 0.0. Repeated rows get equal scores. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_batches, map_batches, staged, texts_of

BUCKETS, LENGTHS = 1 << 18, (3, 4, 5)
SAMPLE_TOXIC, SAMPLE_OTHER, SAMPLE_BYTES = 1000, 2000, 64 << 20
#: Logistic regression: penalty, most steps of the limited-memory quasi-Newton method, and the gain below which it ends.
PENALTY, STEPS, ENOUGH = 3e-5, 40, 3e-5
#: A feature's rate is its count in so many n-grams; texts with few n-grams count as LEAST.
RATE, LEAST = 3000, 30
#: Training texts that are gone through at once.
BLOCK = 256


def features(text: bytes, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct n-grams, and their values. seen: room for BUCKETS integers, used again from text to text."""
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    found, h = [], points * np.uint32(0x9E3779B1)
    for n in range(2, max(LENGTHS) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + points[n - 1 :]
        if n in LENGTHS:
            x = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE3D)
            found.append(x >> np.uint32(32 - BUCKETS.bit_length() + 1))
    every = np.concatenate(found)
    seen = np.empty(BUCKETS, np.int32) if seen is None else seen
    seen[every] = np.arange(len(every), dtype=np.int32)
    count = np.bincount(seen[every], minlength=len(every))  # at one place of each bucket
    one = np.flatnonzero(count)
    return every[one], np.log1p(count[one] * (RATE / max(len(every), LEAST))).astype(np.float32) / 3


def fit(texts: list[bytes], labels: list[int], penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """The number of each bucket, and the bias."""
    y = np.array(labels, float)
    if not 0 < y.sum() < len(y):
        return np.zeros(BUCKETS, np.float32), -np.inf
    blocks = []  # of rows: feature, value, row
    p, q, df = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS, np.int32)
    for b in range(0, len(texts), BLOCK):
        rows = [features(t) for t in texts[b : b + BLOCK]]
        flat, value = (np.concatenate(x) for x in zip(*rows))
        of = np.repeat(np.arange(len(rows), dtype=np.int16), [len(x) for x, _ in rows])
        toxic = y[b + of.astype(np.int32)] == 1
        for total, mine in ((p, toxic), (q, ~toxic)):
            total += np.bincount(flat[mine], value[mine], minlength=BUCKETS)
        df += np.bincount(flat, minlength=BUCKETS).astype(np.int32)
        blocks.append((b, len(rows), flat.astype(np.int32), value, of))
    smooth = (p.sum() + q.sum()) / max(df.sum(), 1)
    r = np.log(p + smooth) - np.log(y.sum()) - np.log(q + smooth) + np.log(len(y) - y.sum())
    r[df < 3] = 0  # in fewer than three texts: nothing to learn
    used = np.flatnonzero(r)
    place, ratio = np.full(BUCKETS, -1, np.int32), r[used]
    place[used] = np.arange(len(used))
    for k, (b, n, flat, value, of) in enumerate(blocks):
        keep = r[flat] != 0
        blocks[k] = b, n, place[flat[keep]], value[keep], of[keep]
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        scaled, slope = w[:-1] * ratio, np.zeros(len(used))
        cost, bias = penalty / 2 * (w[:-1] ** 2).sum(), 0.0
        for b, n, flat, value, of in blocks:
            c, t = balance[b : b + n], y[b : b + n]
            s = np.bincount(of, scaled[flat] * value, minlength=n) + w[-1]
            g = c * (1 / (1 + np.exp(-np.clip(s, -500, 500))) - t)
            cost += (c * (np.logaddexp(0, s) - t * s)).sum()
            slope += np.bincount(flat, g[of] * value, minlength=len(used))
            bias += g.sum()
        return cost, np.append(slope * ratio + penalty * w[:-1], bias)

    w = minimise(loss, np.zeros(len(used) + 1), steps)
    out = np.zeros(BUCKETS, np.float32)
    out[used] = w[:-1] * ratio
    return out, float(w[-1])


def minimise(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with a halving line search."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = -g, []
        for s, v in reversed(past):
            a = s @ d / (s @ v)
            d = d - a * v
            kept.append(a)
        if past:
            s, v = past[-1]
            d = d * (s @ v) / (v @ v)
        for (s, v), a in zip(past, reversed(kept)):
            d = d + (a - v @ d / (s @ v)) * s
        slope, step = g @ d, 1.0
        while (new := f(x + step * d))[0] > value + 1e-4 * step * slope and step > 1e-8:
            step /= 2
        small = value - new[0] < ENOUGH
        s, v = step * d, new[1] - g
        if s @ v > 1e-12:
            past = [*past, (s, v)][-memory:]
        x, value, g = x + s, *new
        if small:
            break
    return x


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = SAMPLE_TOXIC, other: int = SAMPLE_OTHER, most_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """Fit on at most toxic + other rows of labels and their texts; see above."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    many = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    picked = []
    for y, n in ((1, toxic), (0, other)):
        # the n smallest hashes lie in the lowest part of their range; twice as many rows are looked at, and all if that were too few
        some = rows.where(F.col("y") == y).withColumn("k", F.xxhash64("id"))
        near = some.where(F.col("k") < F.lit(int(-(2**63) + min(1.0, 2 * n / max(many.get(y, 0), 1)) * (2**64 - 2048)))) if many.get(y, 0) > 4 * n else some
        found = near.orderBy("k", "id").limit(n).select("id", "y").collect()
        picked += found if len(found) == n or near is some else some.orderBy("k", "id").limit(n).select("id", "y").collect()
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(r.id,) for r in picked], "id long").distinct())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # one text per id, so no more than were picked come to the driver however often documents repeat an id
    own = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t")).join(wanted, "id").groupBy("id").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("x"))
    own = staged(own.select("id", "x.t"), "toxicity-sample")
    size = {r.id: r.n for r in own.select("id", F.octet_length("t").alias("n")).collect()}
    labels_of: dict[int, list[int]] = {}
    for y in (1, 0):
        total = 0
        for r in picked:
            if r.y == y and r.id in size and (not total or total + size[r.id] <= most_bytes):
                total += size[r.id] + 1
                labels_of.setdefault(r.id, []).append(y)
            elif r.y == y and r.id in size:
                break
    chosen = spark.createDataFrame([(i,) for i in labels_of], "id long")
    sample = sorted((r.id, y, r.t.encode()) for r in own.join(F.broadcast(chosen), "id").toLocalIterator() for y in labels_of[r.id])
    return fit([t for _, _, t in sample], [y for _, y, _ in sample])


def score(text: bytes, weights: np.ndarray, bias: float, seen: np.ndarray | None = None) -> float:
    at, value = features(text, seen)
    s = float(weights[at] @ value) + bias
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, s)))) if s > -np.inf else 0.0


def scored(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score."""
    weights = docs.sparkSession.sparkContext.broadcast(model)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = weights.value
        seen = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            out = []
            for t in texts_of(batch["text"]):
                out.append(score(t, w, bias, seen))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(out, pa.float64())], ["id", "score"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), f, "id bigint, score double")


def filtered(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs that score below least, with all their columns; null texts are empty, repeated rows stay or go together."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep():
        seen = np.zeros(BUCKETS, np.int32)
        return lambda texts: [score(t, *shared.value, seen) < least for t in texts]

    return kept_batches(docs, keep, text_col)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """From the labelled rows that are not held out."""
    return train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic").where(~held_out()))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs, train_on(docs, labels))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
