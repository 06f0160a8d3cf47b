"""Scores of texts under a hierarchical Pitman-Yor language model over words.

A word's restaurant is that of its context, the word before it, or the start of the text. The EXACT_CONTEXTS words that are most frequent
(of all texts that are learned from) have a restaurant each, as all words have in a corpus of no more; rarer ones share HASHED restaurants by hash. So the totals
that all tasks share have a fixed size, while pairs and dishes grow with the corpus. All
context restaurants share one parent, the restaurant of single words, whose base is uniform over the words known and one
unknown word. A table of a context restaurant is a customer of the parent.

Seating is sampled by blocked Gibbs steps: all customers of a dish rise, and their number of tables is
drawn given everything else, p(t) in proportion to S(c, t) * A^t, with generalised Stirling numbers S and A the
weight of a new table. For dishes with more than EXACT customers the numbers come from a grid of contour integrals, and where more than
FEW / 2 tables are expected t is drawn from the normal law about the saddle point. The parts of the vocabulary are sampled in parallel; the totals of each
restaurant that they share are exchanged between ROUNDS rounds, and strengths are drawn from them each time by auxiliary variables (gamma priors). Discounts are estimated from
counts. Predictive probabilities are averaged over SAMPLES draws
with their own totals, so that those of a context sum to one. What is drawn for a dish comes from its word, its context, the seed and the step, and
totals are whole numbers, so scores depend on the corpus and the seed, but for the last digits: not on parts, tasks or settings.

Texts travel packed: a stretch of text sends each part of the vocabulary one row of distinct (word, context)
pairs, with counts to learn from, with documents to score. Nothing is sent to the driver but sums of fixed
size.

Edge cases. Null text is empty: only the end token. Rows with a null id are learned from like others and not held out. Repeated rows count again
and get equal scores. With nothing to learn from every token has probability one. An empty table gives no rows.
Other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED_ROWS, ROW_BY_ROW, partitions, parts_for, rows_of, staged, texts_of, whole_text
from .common import map_batches as _map
from .words import word_hashes

#: Numbers of contexts: the start, the most frequent words, and what the others share by hash.
CONTEXT_BITS = 16
CONTEXTS, HASHED = 1 << CONTEXT_BITS, 1 << 14
EXACT_CONTEXTS = CONTEXTS - HASHED - 1
#: Words that a map task counts before it passes them on; steps of the histogram of counts to the octave.
COUNTED, STEPS_OF_COUNTS = 1 << 18, 64
EXACT, SAMPLES, BURN_IN, ROUNDS = 256, 3, 2, 2
#: Tables to which the law is tabulated for more than EXACT customers, and grid points of the customers to the octave.
FEW, STEPS = 192, 3
#: First strengths of the context restaurants and of their parent, which are sampled then; shape and rate of their prior.
STRENGTH, PARENT_STRENGTH, PRIOR = 1.0, 10.0, (1.0, 1.0)
#: Bytes of text, and documents, that a map task packs at once; pairs that an owner adds up at once.
STRETCH, STRETCH_DOCS, MERGE = 6 << 20, 60_000, 1 << 19
#: Bytes of text to a part of the vocabulary: a part is a row (its model of some 1.3 times as much), which the JVM and a worker hold several times.
PART_BYTES = 8 << 20
#: Documents' sums that an owner holds before it passes them on.
HELD = 1 << 22
#: What all owners pass on of all documents' sums, as a share of the texts, and owners at least.
SUMS_SHARE, LEAST_OWNERS = 1 / 3, 16

END = np.uint64(0x8E5B2C1F9D3A7046)

PACKED = "part int, stretch bigint, words binary, pairs binary, contexts binary, counts binary, docs binary, ids array<bigint>"
COUNTS = "part int, words binary, pairs binary, contexts binary, counts binary, sums binary"
SEATED = "part int, words binary, pairs binary, contexts binary, counts binary, tables binary, parent binary, sums binary"
SUMS = "sums binary"
PARTIAL = "stretch bigint, part int, base binary, score binary, known binary, docs binary, ids array<bigint>"
#: Bytes of a document's sums.
SUM_BYTES = 20
SCORED = "id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def map_batches(df: DataFrame, f, schema: str) -> DataFrame:
    return _map(df, f, schema, PACKED_ROWS)


def context_codes(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The number of the context that each word is; frequent: sorted hashes of the words with contexts of their own."""
    code = 1 + EXACT_CONTEXTS + ((words & np.uint64(0xFFFFFFFF)) * np.uint64(HASHED) >> np.uint64(32)).astype(np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
        code = np.where(frequent[at] == words, 1 + at, code)
    return code


def tokens(texts: list[bytes], frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the word (or END), context and number of the text, for all tokens of the texts."""
    words, count = word_hashes(texts)
    last = np.cumsum(count + 1) - 1
    hashes = np.full(len(words) + len(texts), END, np.uint64)
    inner = np.ones(len(hashes), bool)
    inner[last] = False
    hashes[inner] = words
    context = np.zeros(len(hashes), np.int64)
    context[1:] = context_codes(hashes[:-1], frequent)
    context[np.append(0, last[:-1] + 1)] = 0
    return hashes, context, np.repeat(np.arange(len(texts)), count + 1)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[int | None]]]:
    """Texts, with their ids, of a stretch."""
    texts: list[bytes] = []
    ids: list[int | None] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch["id"].to_pylist(), texts_of(batch["text"])):
            if texts and (size + len(t) > STRETCH or len(texts) == STRETCH_DOCS):
                yield texts, ids
                texts, ids, size = [], [], 0
            texts.append(t)
            ids.append(i)
            size += len(t)
    if texts:
        yield texts, ids


def _counts(held: int):
    """The words of a task's texts with their counts, passed on when more than `held` of them are at hand: a word may come more than once."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, count = np.empty(0, np.uint64), np.empty(0, np.int64)
        for texts, _ in _stretches(batches):
            own, n = np.unique(word_hashes(texts)[0], return_counts=True)
            words, near = np.unique(np.concatenate((words, own)), return_inverse=True)
            count = np.bincount(near, np.concatenate((count, n)), len(words)).astype(np.int64)
            if len(words) > held:
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(count)], ["w", "c"])
                words, count = words[:0], count[:0]
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(count)], ["w", "c"])

    return f


def frequent_words(texts: DataFrame, most: int = EXACT_CONTEXTS) -> np.ndarray:
    """Sorted hashes of the `most` most frequent words, of equal counts those of the least hashes; all words of all texts are counted.

    Tasks send what is above a count that a histogram of counts (STEPS_OF_COUNTS to the octave) gives, so the driver and the last sort
    get about as many rows as asked for, and not so many from every task; only words of that last step are taken in part.
    """
    counted = staged(map_batches(texts, _counts(COUNTED), "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c")), "lm-words")
    step = F.floor(F.log2("c") * STEPS_OF_COUNTS).cast("int")
    above, least = 0, 0
    for r in sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True):
        if above + r["count"] > most:
            last = counted.where(step == r.step).orderBy(F.desc("c"), "w").limit(most - above)
            break
        above, least = above + r["count"], r.step
    else:
        last = None
    sure = counted.where(step >= least) if above else counted.limit(0)
    top = (sure if last is None else sure.unionByName(last)).select("w").toPandas()
    return np.sort(top["w"].to_numpy(np.int64).view(np.uint64))


def part_of(words: np.ndarray, parts: int) -> np.ndarray:
    return (words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _row(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "double": pa.float64()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [c for c, _ in fields])


class Hot:
    """Words with more than one part's share of all tokens: copies of each one's model stand in parts of their own, and
    stretches take turns at them. The words are at most as many as the parts, their copies at most twice as many."""

    def __init__(self, counts: dict[int, int], parts: int, total: int):
        self.words = np.array(sorted(counts), np.uint64)
        self.copies = np.array([-(-counts[w] * parts // max(total, 1)) for w in sorted(counts)], np.int64)
        self.first = parts + np.cumsum(self.copies) - self.copies

    def place(self, words: np.ndarray, part: np.ndarray, stretch: int) -> np.ndarray:
        if not len(self.words):
            return part
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.first[at] + stretch % self.copies[at], part.astype(np.int64))


def _pack(parts: int, learn: bool, shared, hot: Hot | None = None):
    """learn: counts of the pairs; else also the document of each token, and a row (part below 0) with the documents' ids."""

    def pack(texts: list[bytes], ids: list[int | None], stretch: int) -> Iterator[pa.RecordBatch]:
        word, context, doc = tokens(texts, shared.value)
        words, near = np.unique(word, return_inverse=True)
        key = np.sort((near.astype(np.int64) << CONTEXT_BITS | context) << 16 | (0 if learn else doc))
        pair = key >> 16
        head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        count = np.diff(np.append(head, len(pair))).astype(np.int32)
        of = pair[head] >> CONTEXT_BITS
        pairs = np.bincount(of, minlength=len(words)).astype(np.int32)
        ctx, docs = (pair[head] & CONTEXTS - 1).astype(np.uint16), (key & 0xFFFF).astype(np.uint16)
        part = part_of(words, parts)
        if hot is not None:
            part = hot.place(words, part, stretch)
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))  # hashes are sorted, so parts are
        pair_at, token_at = np.append(0, np.cumsum(pairs)), np.append(head, len(pair))
        for b, e in zip(cut.tolist(), [*cut[1:].tolist(), len(words)]):
            p, q = pair_at[b], pair_at[e]
            own = b"" if learn else docs[token_at[p] : token_at[q]].tobytes()
            yield _row(PACKED, [(int(part[b]), stretch, words[b:e].tobytes(), pairs[b:e].tobytes(), ctx[p:q].tobytes(), count[p:q].tobytes(), own, None)])
        if not learn:
            yield _row(PACKED, [(-1 - stretch % parts, stretch, b"", b"", b"", b"", np.bincount(doc, minlength=len(texts)).astype(np.int32).tobytes(), ids)])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, (texts, ids) in enumerate(_stretches(batches), TaskContext.get().partitionId() << 24):
            yield from pack(texts, ids, n)

    return f


def _unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words; of each pair the word's number, context and count."""
    words, pairs = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["pairs"], np.int32)
    return words, np.repeat(np.arange(len(words), dtype=np.int64), pairs), np.frombuffer(r["contexts"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.int32).astype(np.int64)


def _sparse(x: np.ndarray) -> bytes:
    """Whole numbers as the places and values that are not zero, packed: most parts of the vocabulary meet most contexts, but with small numbers."""
    at = np.flatnonzero(x)
    return zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes() + np.rint(x[at]).astype(np.int64).tobytes(), 1)


def _add_sparse(total: np.ndarray, x: bytes) -> None:
    x = zlib.decompress(x)
    n = len(x) // 12
    total[np.cumsum(np.frombuffer(x, np.uint32, n), dtype=np.int64)] += np.frombuffer(x, np.int64, n, 4 * n)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part: the counts of each part, and what the restaurants need to know of it."""
    waiting: list[tuple] = []
    part, size = None, 0

    def merge() -> None:
        nonlocal waiting, size
        words = np.unique(np.concatenate([w for w, _, _, _ in waiting]))
        key = np.concatenate([np.searchsorted(words, w)[n] << CONTEXT_BITS | c for w, n, c, _ in waiting])
        count = np.concatenate([c for _, _, _, c in waiting])
        order = np.argsort(key)
        key, count = key[order], count[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        waiting, size = [(words, key[head] >> CONTEXT_BITS, key[head] & CONTEXTS - 1, np.add.reduceat(count, head))], 0

    def finish() -> pa.RecordBatch:
        merge()
        words, near, ctx, count = waiting[0]
        kinds = np.bincount(np.minimum(np.bincount(near, minlength=len(words)), 3), minlength=4)  # pairs that words are in
        sums = np.concatenate((np.bincount(ctx, count, CONTEXTS), np.bincount(ctx, minlength=CONTEXTS), [count.sum(), len(words), (count == 1).sum(), (count == 2).sum(), kinds[1], kinds[2]])).astype(float)
        return _row(COUNTS, [(part, words.tobytes(), np.bincount(near, minlength=len(words)).astype(np.int32).tobytes(), ctx.astype(np.uint16).tobytes(), count.astype(np.int32).tobytes(), _sparse(sums))])

    for batch in batches:
        for r in rows_of(batch):
            if waiting and r["part"] != part:
                yield finish()
                waiting, size = [], 0
            part = r["part"]
            waiting.append(_unpacked(r))
            size += len(waiting[-1][1])
            if size > MERGE:
                merge()
    if waiting:
        yield finish()


def _total(size: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            for x in batch["sums"].to_pylist():
                _add_sparse(total, x)
                some = True
        if some:
            yield _row(SUMS, [(_sparse(total),)])

    return f


def totals(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of the vectors of all parts; at most 16 of them reach the driver."""
    total = np.zeros(size)
    partial = map_batches(rows.select("sums"), _total(size), SUMS)  # of each task, before they are shuffled
    for r in map_batches(partial.repartition(16), _total(size), SUMS).collect():
        _add_sparse(total, r.sums)
    return total


def sampled_strength(strength: float, discount: float, customers: np.ndarray, tables: np.ndarray, rng: np.random.Generator, chunk: int = 1 << 20) -> float:
    """A draw of the strength of restaurants with so many customers and tables, given the last one: by a beta variable for each restaurant and a
    Bernoulli variable for each table but the first."""
    shape, rate = PRIOR
    some = customers >= 2
    rate -= np.log(rng.beta(strength + 1, customers[some] - 1)).sum()
    ordered = np.sort(tables[tables >= 2]).astype(np.int64)
    for b in range(1, int(ordered[-1]) if len(ordered) else 1, chunk):
        i = np.arange(b, min(b + chunk, int(ordered[-1])))
        open_ = len(ordered) - np.searchsorted(ordered, i, "right")  # restaurants with an i-th table beyond the first
        shape += rng.binomial(open_, strength / (strength + discount * i)).sum()
    return float(rng.gamma(shape, 1 / rate))


def stirling(size: int, discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) of all c and t up to size."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(size + 1)
    for c in range(size):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
        out[c + 1] = np.logaddexp(np.append(-np.inf, out[c, :-1]), np.where(t <= c, stay, -np.inf))
    return out


@lru_cache(4)
def large(discount: float) -> np.ndarray:
    """log S(c, t) - log S(c, 1) for c on a grid of STEPS to the octave from EXACT to 2^40 and t to FEW.

    S(c, t) = c!/t! [x^c] f(x)^t with f(x) = (1 - (1 - x)^d)/d; the coefficient is Cauchy's integral along the parabola
    log x = -m (1 + iu)^2 by the trapezoidal rule, where m is the saddle point, or beside the singularity of f 2/c.
    """
    t = np.arange(1, FEW + 1)
    ln_t = np.cumsum(np.log(t))
    u = np.linspace(-9, 9, 361)
    rows = []
    for c in EXACT * 2.0 ** (np.arange(32 * STEPS + 1) / STEPS):
        lo, hi = np.full(FEW, -60.0), np.full(FEW, 5.0)  # of log m
        for _ in range(50):
            mid = (lo + hi) / 2
            y = -np.expm1(-np.exp(mid))
            under = t * np.exp(-np.exp(mid)) * discount * y ** (discount - 1) / (1 - y**discount) > c
            lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
        m = np.maximum(np.exp(lo), 2 / c)
        # the integrand falls like a normal density about the saddle point: as many widths of it as u has
        y = -np.expm1(-m)
        wide = np.minimum(0.7, 2.0 / np.sqrt(np.maximum(c * m, 1)))
        v = wide[:, None] * u
        s = m[:, None] * (1 + 1j * v) ** 2
        z = t[:, None] * np.log((1 - (-np.expm1(-s)) ** discount) / discount) + c * s
        top = z.real.max(1, keepdims=True)
        total = (np.exp(z - top) * (1 + 1j * v)).real.sum(1) * m * wide
        rows.append(np.log(np.maximum(total, 1e-300)) + top[:, 0] - ln_t)
    return np.array([r - r[0] for r in rows])


def _seat_large(c: np.ndarray, weight: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """The same law for more than EXACT customers: from the grid if about FEW / 2 tables or fewer are expected, else the normal law about its saddle point."""
    tables = np.empty(len(c), np.int64)
    small = c <= EXACT
    if small.any():  # the caller's numbers end earlier
        tables[small] = _seat_small(c[small].astype(np.int64), weight[small], stirling(EXACT, discount), u[small])
    # tables have Poisson numbers and sizes of weights f's coefficients, given that sizes add up to c: w x (1 - x)^(d - 1) = c, y = 1 - x
    lo, hi = np.full(len(c), -2000.0), np.zeros(len(c))
    for _ in range(60):
        mid = (lo + hi) / 2
        under = np.log(weight) + np.log(-np.expm1(mid)) > np.log(c) + (1 - discount) * mid
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    y = np.exp(np.maximum(lo, -600))
    mean = weight * -np.expm1(discount * lo) / discount
    spread = np.sqrt(np.maximum(mean - c / (1 + (1 - discount) * (1 - y) / y), 0))
    far = np.flatnonzero(~small & (mean > FEW / 2))
    normal = np.sqrt(-2 * np.log1p(-u[far])) * np.cos(2 * np.pi * uniform(mixed(u[far].view(np.uint64))))
    tables[far] = np.clip(np.rint(mean[far] + spread[far] * normal), 1, c[far]).astype(np.int64)
    near = np.flatnonzero(~small & (mean <= FEW / 2))
    grid = large(discount) if len(near) else None
    for k in range(0, len(near), 4096):
        at = near[k : k + 4096]
        place = STEPS * np.log2(c[at] / EXACT)
        first = np.clip(np.floor(place).astype(np.int64) - 1, 0, len(grid) - 4)
        x = place - first
        cubic = (-(x - 1) * (x - 2) * (x - 3) / 6, x * (x - 2) * (x - 3) / 2, -x * (x - 1) * (x - 3) / 2, x * (x - 1) * (x - 2) / 6)
        p = sum(q[:, None] * grid[first + j] for j, q in enumerate(cubic)) + np.log(weight[at])[:, None] * np.arange(1, FEW + 1)
        p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), 1)
        tables[at] = 1 + (p[:, :-1] < u[at][:, None] * p[:, -1:]).sum(1)
    return tables


def _seat_small(count: np.ndarray, weight: np.ndarray, numbers: np.ndarray, u: np.ndarray) -> np.ndarray:
    tables = np.minimum(count, 1)
    some = np.flatnonzero((count > 1) & (count < len(numbers)))
    some = some[np.argsort(count[some], kind="stable")]
    value, first = np.unique(count[some], return_index=True)
    for c, b, e in zip(value.tolist(), first.tolist(), [*first[1:].tolist(), len(some)]):
        row, t = numbers[c, 1 : c + 1], np.arange(1, c + 1)
        for k in range(b, e, max(1, (1 << 20) // c)):
            at = some[k : min(e, k + max(1, (1 << 20) // c))]
            p = row + np.log(weight[at])[:, None] * t
            p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), 1)
            tables[at] = 1 + (p[:, :-1] < u[at][:, None] * p[:, -1:]).sum(1)
    return tables


def seat(count: np.ndarray, weight: np.ndarray, discount: float, numbers: np.ndarray, rng) -> np.ndarray:
    """Numbers of tables, drawn for dishes of so many customers, at which a new table has such a weight. rng: one uniform number per dish."""
    u = rng.random(len(count))
    tables = _seat_small(count, weight, numbers, u)
    many = np.flatnonzero(count >= len(numbers))
    if len(many):
        tables[many] = _seat_large(count[many].astype(float), weight[many], discount, u[many])
    return tables


def mixed(x: np.ndarray) -> np.ndarray:
    """Each number's 64 bits, mixed one to one by shifts and multiplications by odd numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)) * 2.0**-53


class Draws:
    """Random numbers of dishes: they come from the dish, the seed and the number of the step, so it makes no difference which task draws them, and with what."""

    def __init__(self, dish: np.ndarray, seed: int):
        self.dish, self.seed, self.step = dish, seed, 0

    def random(self, n: int) -> np.ndarray:
        self.step += 1
        return uniform(mixed(self.dish ^ mixed(np.array([self.seed << 20 | self.step], np.uint64) * np.uint64(0xA0761D6478BD642F))))


class Restaurants:
    """Totals that all parts share: customers and tables of the contexts, and of the parent."""

    def __init__(self, customers: np.ndarray, tables: np.ndarray, parent_customers: float, parent_tables: float, words: float, discounts: tuple[float, float], strengths: tuple[float, float] = (STRENGTH, PARENT_STRENGTH)):
        self.customers, self.tables, self.parent_customers, self.parent_tables = customers, tables, parent_customers, parent_tables
        self.words, (self.discount, self.parent_discount), (self.strength, self.parent_strength) = words, discounts, strengths

    def new_word(self):
        """The weight of a new table at the parent."""
        return (self.parent_strength + self.parent_discount * self.parent_tables) / (self.words + 1)

    def parent(self, customers, tables):
        """Predictive probability of a word with so many customers and tables at the parent."""
        return (customers - self.parent_discount * tables + self.new_word()) / (self.parent_strength + self.parent_customers)

    def probability(self, context, count, tables, parent):
        new = (self.strength + self.discount * self.tables[context]) * parent
        return (count - self.discount * tables + new) / (self.strength + self.customers[context])


def _seat_all(shared, draws: int, burn_in: int, seed: int):
    """A chain for each part: the last draws are kept."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Restaurants = shared.value
        numbers, parents = stirling(EXACT, state.discount), stirling(EXACT, state.parent_discount)
        base = state.new_word()
        for batch in batches:
            for r in rows_of(batch):
                words, near, ctx, count = _unpacked(r)
                again = np.flatnonzero(count > 1)
                at_parent, at_context = Draws(words, 2 * seed), Draws(mixed(words[near[again]] + ctx[again].astype(np.uint64)), 2 * seed + 1)
                tables = np.minimum(count, 1)
                served = np.bincount(near, tables, len(words)).astype(np.int64)
                parent = seat(served, np.full(len(words), base), state.parent_discount, parents, at_parent)
                kept, parent_kept, sums = [], [], []
                for n in range(burn_in + draws):
                    # the dish's own tables leave the parent while they are drawn
                    rest = np.maximum(served[near[again]] - tables[again], 0)
                    p = state.parent(rest, np.minimum(parent[near[again]], rest))
                    tables[again] = seat(count[again], (state.strength + state.discount * state.tables[ctx[again]]) * p, state.discount, numbers, at_context)
                    served = np.bincount(near, tables, len(words)).astype(np.int64)
                    parent = seat(served, np.full(len(words), base), state.parent_discount, parents, at_parent)
                    if n >= burn_in:
                        kept.append(tables.astype(np.int32).tobytes())
                        parent_kept += [served.astype(np.int32).tobytes(), parent.astype(np.int32).tobytes()]
                        sums.append(np.concatenate((np.bincount(ctx, tables, CONTEXTS), [served.sum(), parent.sum()])))
                yield _row(SEATED, [(r["part"], r["words"], r["pairs"], r["contexts"], r["counts"], b"".join(kept), b"".join(parent_kept), _sparse(np.concatenate(sums)))])

    return f


def _score(shared, tokens_all: float, words_all: float):
    """Rows sorted by part, with the part's model (stretch null) first: sums per document of each stretch."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[Restaurants] = shared.value
        part, model = None, None
        none = [s.parent(0.0, 0.0) for s in states]
        sums: dict[int, list[np.ndarray]] = {}  # by stretch: base, score, known, added up over the parts of this task
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for stretch, (base, score, known) in sums.items():
                docs = np.flatnonzero((base != 0) | (score != 0) | (known != 0))
                few = len(docs) * (SUM_BYTES + 2) < len(base) * SUM_BYTES
                base, score, known = (x[docs] if few else x for x in (base, score, known))
                yield _row(PARTIAL, [(stretch, 0, base.tobytes(), score.tobytes(), known.tobytes(), docs.astype(np.uint16).tobytes() if few else None, None)])

        def load(r: dict | None) -> tuple:
            if r is None:
                empty = np.empty(0, np.int64)
                return np.empty(0, np.uint64), empty, np.empty(0), empty, [np.empty(0)] * len(states)
            words, near, ctx, count = _unpacked(r)
            tables = np.frombuffer(r["tables"], np.int32).reshape(len(states), -1)
            served = np.frombuffer(r["parent"], np.int32).reshape(len(states), 2, -1)
            parent = [s.parent(c.astype(float), t) for s, (c, t) in zip(states, served)]
            log = np.log10(sum(s.probability(ctx, count, t, p[near]) for s, t, p in zip(states, tables, parent)) / len(states))
            return words, near << CONTEXT_BITS | ctx, log, np.bincount(near, count, len(words)), parent

        for batch in batches:
            for r in rows_of(batch):
                if r["part"] < 0:
                    yield _row(PARTIAL, [(r["stretch"], -1, b"", b"", r["docs"], None, r["ids"])])
                    continue
                if r["part"] != part:
                    part, model = r["part"], load(r if r["stretch"] is None else None)
                if r["stretch"] is None:
                    continue
                words, keys, log, total, parent = model
                asked, near, ctx, count = _unpacked(r)
                docs = np.frombuffer(r["docs"], np.uint16)
                at = np.searchsorted(words, asked)
                known = at < len(words)
                known[known] = words[at[known]] == asked[known]
                base = np.log10((np.where(known, total[np.where(known, at, 0)] if len(total) else 0.0, 0.0) + 1) / (tokens_all + words_all + 1))
                at, is_known = at[near], known[near]
                key = at << CONTEXT_BITS | ctx
                place = np.searchsorted(keys, key)
                seen = is_known & (place < len(keys))
                seen[seen] = keys[place[seen]] == key[seen]
                score = np.empty(len(near))
                score[seen] = log[place[seen]]
                for want, odds in ((is_known & ~seen, lambda k: parent[k][at[is_known & ~seen]]), (~is_known, lambda k: none[k])):
                    if want.any():
                        score[want] = np.log10(sum(s.probability(ctx[want], 0.0, 0.0, odds(k)) for k, s in enumerate(states)) / len(states))
                new = [np.bincount(docs, np.repeat(x, count)) for x in (base[near], score, is_known)]
                new[2] = new[2].astype(np.int32)
                old = sums.get(r["stretch"])
                if old is None:
                    sums[r["stretch"]] = new
                    held += len(new[0])
                else:
                    for k in range(3):
                        long, short = (old[k], new[k]) if len(old[k]) >= len(new[k]) else (new[k], old[k])
                        long[: len(short)] += short
                        old[k] = long
                if held > HELD:
                    yield from flush()
                    sums.clear()
                    held = 0
        yield from flush()

    return f


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by stretch, the one with the ids first."""
    ids = None

    def finish() -> Iterator[pa.RecordBatch]:
        for k in range(0, len(ids), 10_000):
            yield _row(SCORED, list(zip(ids[k : k + 10_000], *(x[k : k + 10_000].tolist() for x in (n, known, base, score)))))

    for batch in batches:
        for r in rows_of(batch):
            if r["part"] == -1:
                if ids is not None:
                    yield from finish()
                ids, n = r["ids"], np.frombuffer(r["known"], np.int32)
                known, base, score = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
                continue
            docs = None if r["docs"] is None else np.frombuffer(r["docs"], np.uint16)
            for total, x in ((known, np.frombuffer(r["known"], np.int32)), (base, np.frombuffer(r["base"], float)), (score, np.frombuffer(r["score"], float))):
                total[slice(len(x)) if docs is None else docs] += x
    if ids is not None:
        yield from finish()


def _frequent(least: float):
    """Words with more tokens than least."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                words, near, _, count = _unpacked(r)
                total = np.bincount(near, count, len(words))
                at = np.flatnonzero(total > least)
                yield pa.RecordBatch.from_arrays([pa.array(words[at].view(np.int64)), pa.array(total[at].astype(np.int64))], ["w", "c"])

    return f


def _copied(hot: Hot, samples: int):
    """The model's rows, and for each copy of a frequent word a row with its part of the model."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_of(batch):
                yield _row(SEATED, [tuple(r.values())])
                words, near, ctx, count = _unpacked(r)
                for w, copies, first in zip(hot.words, hot.copies.tolist(), hot.first.tolist()):
                    k = int(np.searchsorted(words, w))
                    if k == len(words) or words[k] != w:
                        continue
                    mine = near == k
                    tables = np.frombuffer(r["tables"], np.int32).reshape(samples, -1)[:, mine]
                    parent = np.frombuffer(r["parent"], np.int32).reshape(samples, 2, -1)[:, :, k]
                    own = (words[k : k + 1].tobytes(), np.array([mine.sum()], np.int32).tobytes(), ctx[mine].astype(np.uint16).tobytes(), count[mine].astype(np.int32).tobytes(), tables.tobytes(), parent.tobytes(), b"")
                    for c in range(copies):
                        yield _row(SEATED, [(first + c, *own)])

    return f


class Model:
    """The seated restaurants: one row per part of the vocabulary, and the totals of every draw. text_bytes: a text's mean size."""

    def __init__(self, seated: DataFrame, states: list[Restaurants], parts: int, tokens_all: int, words_all: int, frequent: np.ndarray, hot: dict[int, int] | None = None, text_bytes: float = 0.0):
        self.seated, self.states, self.parts, self.tokens, self.words, self.frequent, self.text_bytes = seated, states, parts, tokens_all, words_all, frequent, text_bytes
        self.hot = Hot(hot or {}, parts, tokens_all)


def fit(texts: DataFrame, parts: int | None = None, samples: int = SAMPLES, burn_in: int = BURN_IN, rounds: int = ROUNDS, seed: int = 0, strengths: tuple[float, float] | None = None) -> Model:
    """texts: text. Learns from all rows. strengths: fixed ones instead of sampled ones."""
    spark = texts.sparkSession
    size = texts.agg(F.coalesce(F.sum(F.octet_length(whole_text()).cast("long")), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    parts = parts or parts_for(spark, size.bytes, PART_BYTES, 4)
    rows = texts.select(F.lit(None).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    frequent = frequent_words(rows)
    packed = map_batches(rows, _pack(parts, True, spark.sparkContext.broadcast(frequent)), PACKED)
    counts = staged(map_batches(packed.repartition(-(-parts // 4), "part").sortWithinPartitions("part", "stretch"), _add_up, COUNTS), "lm-counts", ROW_BY_ROW)
    sums = totals(counts, 2 * CONTEXTS + 6)
    customers, kinds = sums[:CONTEXTS], sums[CONTEXTS : 2 * CONTEXTS]
    n, words, once, twice, one, two = sums[2 * CONTEXTS :]
    discounts = tuple(min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5 for a, b in ((once, twice), (one, two)))
    rng, fixed = np.random.default_rng(seed), strengths
    state = Restaurants(customers, kinds, kinds.sum(), words, words, discounts, strengths or (STRENGTH, PARENT_STRENGTH))
    for k in range(rounds):
        drawn = totals(map_batches(counts, _seat_all(spark.sparkContext.broadcast(state), 1, burn_in, seed + k), SEATED), CONTEXTS + 2)
        tables, parent = drawn[:CONTEXTS], drawn[CONTEXTS:]
        if not fixed:
            strengths = sampled_strength(state.strength, discounts[0], customers, tables, rng), sampled_strength(state.parent_strength, discounts[1], parent[:1], parent[1:], rng)
        state = Restaurants(customers, tables, *parent, words, discounts, strengths)
    seated = staged(map_batches(counts, _seat_all(spark.sparkContext.broadcast(state), samples, burn_in, seed + rounds), SEATED), "lm-seated", ROW_BY_ROW)
    drawn = totals(seated, samples * (CONTEXTS + 2)).reshape(samples, -1)
    hot = {r.w & (1 << 64) - 1: r.c for r in map_batches(counts, _frequent(n / parts), "w bigint, c bigint").collect()}  # at most as many as parts
    states = [Restaurants(customers, x[:CONTEXTS], *x[CONTEXTS:], words, discounts, (state.strength, state.parent_strength)) for x in drawn]
    return Model(seated, states, parts, int(n), int(words), frequent, hot, size.bytes / max(size.rows, 1))


def owners(model: Model, docs: int) -> int:
    """Tasks that score: each holds and passes on the sums of all documents, once where it can hold them, so they are no more than SUMS_SHARE of the texts allows.
    More documents are passed on part by part, those alone that have the part's words, and so by any number of owners."""
    most = -(-model.parts // 4)
    return most if docs > HELD else min(most, max(LEAST_OWNERS, int(model.text_bytes * SUMS_SHARE / SUM_BYTES)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, n_known, base_score, score (log10)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = map_batches(rows, _pack(model.parts, False, spark.sparkContext.broadcast(model.frequent), model.hot), PACKED).withColumns({"tables": F.lit(None).cast("binary"), "parent": F.lit(None).cast("binary")})
    seated = map_batches(model.seated, _copied(model.hot, len(model.states)), SEATED).select("part", F.lit(None).cast("long").alias("stretch"), "words", "pairs", "contexts", "counts", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("array<bigint>").alias("ids"), "tables", "parent")
    dealt = seated.unionByName(asked).repartition(owners(model, docs.count()), "part").sortWithinPartitions("part", F.asc_nulls_first("stretch"))
    sums = map_batches(dealt, _score(spark.sparkContext.broadcast(model.states), model.tokens, model.words), PARTIAL)
    return map_batches(sums.repartition(partitions(spark), "stretch").sortWithinPartitions("stretch", "part"), _gather, SCORED)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def op9_pitman_yor(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs.where(~held_out()).select("text"))
    return scored(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
