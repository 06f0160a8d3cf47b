"""Text quality by gradient-boosted trees over document statistics.

Statistics of the whole text (shares of kinds of characters, lengths of words and lines, repeated words, word pairs and lines, endings) are made by numpy, at most
STRETCH bytes at a time. For training they are cut into at most BINS bins a statistic, at quantiles; each tree is grown level by level from
histograms of first and second derivatives of the logistic loss per node, statistic and bin. The fitted trees are flattened into four arrays (statistic, threshold, first
child, value); a leaf is its own child. All trees walk down together: in each of DEPTH steps, one numpy operation moves every text of a batch in every tree to
the next node. The model has at most TREES * 2 ** (DEPTH + 1) nodes whatever the input, and scoring needs no shuffle.

It is fitted on about SAMPLE rows of each label, those whose hash of the id is least; all texts are read whole. Only their statistics, one row of some
thirty numbers for each, reach the driver. Rows are weighted so that the labels have the shares they have among all labelled rows, so scores are probabilities.

Edge cases. Null text is empty; a text without words has the score that its statistics, mostly zeros, get. Rows with a null label or id are not learned from; a label
that repeats an id counts once (the larger one, if they differ); of documents that repeat an id one text is learned from. With labels of one kind
only, every score is 0.5 (no labels at all) or that label's share. Repeated rows get equal scores. In texts above STRETCH bytes, a word or line over the border of two
stretches counts as two. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged, texts_of
from .pfp import Rolling
from .toxicity import held_out
from .words import NORMAL

SAMPLE, STRETCH = 5000, 1 << 20
TREES, DEPTH, BINS, RATE = 80, 4, 64, 0.15
#: Penalty on leaf values, least second derivatives in a leaf, and least gain of a split.
PENALTY, LEAST_WEIGHT, LEAST_GAIN = 1.0, 1.0, 1e-3

KINDS = ("upper", "lower", "digit", "space", "stop", "shout", "quote", "symbol", "other")
NAMES = (
    "bytes", "words", "lines", *(f"{k} share" for k in KINDS), "upper of letters", "word length", "word length spread", "short words", "long words", "distinct words", "most frequent word", "same word again",
    "distinct pairs", "words without letters", "words ending in a symbol", "words ending in a stop", "line length", "distinct lines", "lines ending in a stop", "byte entropy", "distinct bytes",
)


def _kind(b: int) -> int:
    c = chr(b)
    if b > 127:
        return 8
    for k, found in enumerate((c.isupper(), c.islower(), c.isdigit(), c.isspace(), c in ".,;:", c in "!?", c in "'\"()-")):
        if found:
            return k
    return 7


KIND = np.array([_kind(b) for b in range(256)], np.uint8)
SPACE, SYMBOL, STOP = (np.array([k in x for k in KIND]) for x in ((3,), (5, 7), (4,)))
LETTER = np.array([k in (0, 1, 8) for k in KIND])
FOLD = np.frombuffer(NORMAL, np.uint8)


def _stretches(text: bytes, most: int) -> Iterator[np.ndarray]:
    """The text in parts that end after white space where there is some."""
    data = np.frombuffer(text, np.uint8)
    at = 0
    while at < len(data):
        part = data[at : at + most]
        if at + most < len(data):
            gaps = np.flatnonzero(SPACE[part])
            part = part[: gaps[-1] + 1] if len(gaps) else part
        yield part
        at += len(part)


def _spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    return edge[::2], edge[1::2]


def _counts(h: np.ndarray) -> np.ndarray:
    """How often each value stands in h."""
    h = np.sort(h)
    return np.diff(np.flatnonzero(np.append(np.diff(h, prepend=h[:1] - h.dtype.type(1)) != 0, True))) if len(h) else np.zeros(0, np.int64)


def statistics(text: bytes, most: int = STRETCH) -> list[float]:
    """The numbers of NAMES for one text."""
    of_byte, hashes, line_hashes = np.zeros(256, np.int64), [], []
    words = long_sum = square = short = long = bare = odd = stops = lines = line_stops = 0
    for data in _stretches(text, most):
        of_byte += np.bincount(data, minlength=256)
        roll = Rolling(FOLD[data])
        begin, end = _spans(~SPACE[data])
        size, last = end - begin, data[end - 1]
        letters = np.concatenate(([0], np.cumsum(LETTER[data])))
        hashes.append(roll.of(begin, end))
        words, long_sum, square = words + len(size), long_sum + int(size.sum()), square + int((size * size).sum())
        short, long = short + int((size <= 2).sum()), long + int((size >= 20).sum())
        bare, odd, stops = bare + int((letters[end] == letters[begin]).sum()), odd + int(SYMBOL[last].sum()), stops + int(STOP[last].sum())
        first, final = _spans(data != 10)
        line_hashes.append(roll.of(first, final))
        lines, line_stops = lines + len(first), line_stops + int(STOP[data[final - 1]].sum())
    n, w, m = max(len(text), 1), max(words, 1), max(lines, 1)
    own, own_lines = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.uint64), *line_hashes])
    counts = _counts(own)
    pairs = own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:]
    kinds = np.bincount(KIND, of_byte, minlength=len(KINDS))
    p = of_byte[of_byte > 0] / n
    mean = long_sum / w
    return [
        np.log1p(len(text)), np.log1p(words), np.log1p(lines), *(kinds / n), kinds[0] / max(kinds[0] + kinds[1], 1), mean, np.sqrt(max(square / w - mean * mean, 0.0)), short / w, long / w, len(counts) / w, counts.max(initial=0) / w,
        (own[1:] == own[:-1]).sum() / w, len(_counts(pairs)) / max(len(pairs), 1), bare / w, odd / w, stops / w, np.log1p(len(text) / m), len(_counts(own_lines)) / m, line_stops / m, abs(float((p * np.log2(p)).sum())), len(p) / 256,
    ]


# -- trees


@dataclass(frozen=True)
class Forest:
    """Flattened trees: node i asks whether x[feature[i]] > threshold[i] and goes to child[i], or child[i] + 1 if so; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The sum over all trees, before the logistic function. x: rows by statistics."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = self.child[at] + (x[row, self.feature[at]] > self.threshold[at])
        return self.value[at].sum(axis=1) + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -700, 700)))


def cuts_of(column: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds at quantiles, halfway between neighbouring values, so that bin k holds what is above cut k-1 and not above cut k."""
    known = np.unique(column)
    if len(known) > bins:
        known = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="lower"))
    return (known[:-1] + known[1:]) / 2


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    """x: rows by statistics, y: 0 or 1, weight: of rows."""
    weight = np.ones(len(y)) if weight is None else weight
    nodes: list[tuple[int, float, int, float]] = []  # feature, threshold, child, value
    roots = []
    share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    if not 0 < share < 1:
        bias = 0.0 if not len(y) else 700.0 if share else -700.0
        return Forest(*(np.zeros(1, t) for t in (np.int64, float, np.int64, float)), np.zeros(1, np.int64), 0, bias)
    cuts = [cuts_of(c, bins) for c in x.T]
    wide, many = max(len(c) for c in cuts) + 1, x.shape[1]
    place = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)  # the bin: how many cuts are below the value
    flat = place + np.arange(many) * wide
    bias = float(np.log(share / (1 - share)))
    raw = np.full(len(y), bias)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (p - y), weight * p * (1 - p)
        roots.append(len(nodes))
        nodes.append((0, np.inf, len(nodes), 0.0))
        level, at = [roots[-1]], np.zeros(len(y), np.int64)  # the level's nodes, and which of them each row is in (-1: in a leaf)
        for step in range(depth + 1):
            own = at >= 0
            size = len(level) * many * wide
            where = (at[own, None] * (many * wide) + flat[own]).ravel()
            hist = [np.bincount(where, np.repeat(v[own], many), minlength=size).reshape(len(level), many, wide) for v in (g, h)]
            total_g, total_h = hist[0][:, 0].sum(axis=1), hist[1][:, 0].sum(axis=1)
            left_g, left_h = hist[0].cumsum(axis=2), hist[1].cumsum(axis=2)
            right_g, right_h = total_g[:, None, None] - left_g, total_h[:, None, None] - left_h
            gain = left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - (total_g**2 / (total_h + PENALTY))[:, None, None]
            gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = -1
            below, goes = [], np.full((len(level), 2), -1)
            splits = np.zeros((len(level), 2), np.int64)
            for k, node in enumerate(level):
                best = int(gain[k].argmax())
                feature, cut = divmod(best, wide)
                if step == depth or gain[k, feature, cut] <= LEAST_GAIN:
                    nodes[node] = 0, np.inf, node, -rate * total_g[k] / (total_h[k] + PENALTY)
                    continue
                nodes[node] = feature, float(cuts[feature][cut]), len(nodes), 0.0
                splits[k] = feature, cut
                for side in (0, 1):
                    goes[k, side] = len(below)
                    below.append(len(nodes))
                    nodes.append((0, np.inf, len(nodes), 0.0))
            rows = np.flatnonzero(own)
            value = np.array([nodes[n][3] for n in level])
            ends = goes[at[rows], 0] < 0
            raw[rows[ends]] += value[at[rows[ends]]]
            right = place[rows, splits[at[rows], 0]] > splits[at[rows], 1]
            at[rows] = np.where(ends, -1, goes[at[rows], right.astype(int)])
            level = below
            if not level:
                break
    feature, threshold, child, value = (np.array(c) for c in zip(*nodes))
    return Forest(feature.astype(np.int64), threshold.astype(float), child.astype(np.int64), value.astype(float), np.array(roots), depth, bias)


# -- tables


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t) for t in texts_of(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(rows, pa.list_(pa.float64()))], ["id", "x"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, x (the numbers of NAMES)."""
    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), _features, "id bigint, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Forest:
    """Fit on about `sample` labelled rows of each label; see above."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
    rows = staged(rows, "quality-labels")
    many = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    lowest = lambda y: int(-(2**63) + min(1.0, sample / max(many.get(y, 0), 1)) * (2**64 - 2048))
    picked = rows.where(F.xxhash64("id") <= F.when(F.col("y") == 1, lowest(1)).otherwise(lowest(0)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(picked), "id").select("id", "text")
    # one text per id, so no more rows than were picked come to the driver however often documents repeat an id
    once = features(texts, "id", "text").groupBy("id").agg(F.min("x").alias("x")).join(F.broadcast(picked), "id")
    found = sorted((r.id, r.y, r.x) for r in once.collect())
    x, y = np.array([r[2] for r in found]).reshape(len(found), len(NAMES)), np.array([r[1] for r in found], float)
    own = {1: max(float(y.sum()), 1.0), 0: max(float(len(y) - y.sum()), 1.0)}
    weight = np.where(y == 1, many.get(1, 0) / own[1], many.get(0, 0) / own[0])
    return fit(x, y, weight * (len(y) / max(weight.sum(), 1e-9)))


def scored(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch["text"])
            x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(NAMES))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(shared.value.scores(x), pa.float64())], ["id", "score"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), f, "id bigint, score double")


def op11_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs, train(docs, labels.select("doc_id", "quality").where(~held_out())))
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
