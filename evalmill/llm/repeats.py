"""Repeated byte strings of a corpus, found in corpus order by prefix-free parsing.

A string of `size` bytes (200) that starts at two places or more is repeated; every byte that one covers goes.

Routing. In every window of `size` bytes the GRAM-byte string with the least rolling hash (leftmost of
equals) is its trigger: it depends on the window's bytes only, so equal windows have equal triggers and
meet at the trigger's owner, whatever documents they are in. Neighbouring windows with one trigger form a run; its
bytes, from the first window's start to the last one's end, are a phrase of the corpus. The phrases
overlap by size-1 bytes, so each window lies in exactly one.

Texts are known by two 64-bit hashes with different seeds, phrases by the rolling hash of their trigger and a hash of
another family (xxHash) of their bytes.

1. Map tasks parse their texts, once per distinct text (by its bytes), and pass on each distinct (trigger, phrase) of a bounded
   stretch of text once; what repeats within the stretch is known to be repeated at once.
   A trigger with many phrases in one stretch has its rows dealt by phrase; its owner is told by a row of its own.
2. Owners read the hashes in order, in a stream. A phrase alone under its trigger holds no repeated window;
   one that occurs twice is repeated altogether. Left are triggers with several phrases: mostly the borders
   of copied passages.
3. For those only, one text per distinct phrase is cut out and sent to the trigger's owner, which puts blocks of
   triggers in corpus order (pfp.corpus_order: suffix arrays of dictionary and parse) and compares neighbours over
   `size` bytes.
   A trigger with more than BLOCK_PHRASES phrases doesn't go to one owner: its windows are
   dealt by their own hashes, of both families.
4. Runs of repeated windows are gathered per text and taken out of it.

Edge cases. Null text is empty. Texts shorter than `size` stay whole, repeated or not. Repeated rows are occurrences like others:
a text of `size` bytes or more that two rows share goes altogether. An empty table gives no rows. Other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import map_batches, partitions, row_key, staged, texts_of, whole_text
from .pfp import Rolling, repeated

SIZE, GRAM = 200, 32
#: Bytes of text that a map task parses at once; phrases of a trigger, and bytes, that an owner puts in order at once.
STRETCH, BLOCK_PHRASES, BLOCK_BYTES = 1 << 20, 20_000, 1 << 19
#: Bits of a place in what parse() compares: it takes STRETCH bytes and a window at once, and no more than 2^PLACE_BITS.
PLACE_BITS = 24
#: Phrases of a trigger in one stretch from which they are dealt by phrase, so that no owner gets all that, say, a common line begins.
CROWDED = 32
#: Phrases of a block from which windows without an equal hash are left out of the order.
CROWD = 1000

#: kind 0: windows known to be repeated; 1: a phrase with its hashes; 2: a phrase whose text is needed.
RUNS = "kind int, deal bigint, a bigint, f bigint, twice boolean, several boolean, tk bigint, tj bigint, rk bigint, s int, n int"
CUT = "a bigint, twice boolean, tk bigint, tj bigint, s int, n int, bytes binary"
MARKS = "tk bigint, tj bigint, s int, n int"


def _batch(columns: list[tuple[str, object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for _, v, kind in columns], [c for c, _, _ in columns])


def _runs(kind: int, a, f, twice, tk, tj, rk, s, n, several=None) -> pa.RecordBatch:
    """several: the trigger is known to have other phrases too, so its rows are dealt by trigger and phrase."""
    several = np.zeros(len(s), bool) if several is None else several
    deal = tk if kind == 0 else np.where(several, a ^ f, a)
    return _batch([("kind", np.full(len(s), kind, np.int32), pa.int32()), ("deal", deal, pa.int64()), ("a", a, pa.int64()), ("f", f, pa.int64()), ("twice", twice, pa.bool_()), ("several", several, pa.bool_()), ("tk", tk, pa.int64()), ("tj", tj, pa.int64()), ("rk", rk, pa.int64()), ("s", s.astype(np.int32), pa.int32()), ("n", n.astype(np.int32), pa.int32())])


def parse(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of the joined texts: trigger hash, phrase hash, number of the text, first window's start in it, windows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < size:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    hashes = Rolling(data)
    low = np.uint64((1 << PLACE_BITS) - 1)  # places of a stretch, under the upper bits of the hash
    gram = hashes.all(GRAM)
    if len(gram) > 1 << PLACE_BITS:
        raise ValueError(f"{len(gram)} places to parse at once, more than {1 << PLACE_BITS}")
    least = gram & ~low | np.arange(len(gram), dtype=np.uint64)
    span, step = size - GRAM + 1, 1
    while step * 2 <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if span > step:
        least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
    at = (least & low).astype(np.int64)  # the trigger's place of every window
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    window = np.flatnonzero(np.arange(len(at)) + size <= ends[of])
    if not len(window):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    new = np.append(True, (at[window[1:]] != at[window[:-1]]) | (of[window[1:]] != of[window[:-1]]))
    first = window[new]
    count = np.diff(np.append(np.flatnonzero(new), len(window)))
    view = memoryview(data)
    phrase = np.array([xxh3_64_intdigest(view[b:e]) for b, e in zip(first.tolist(), (first + count - 1 + size).tolist())], np.uint64)
    text = of[first]
    return gram[at[first]].view(np.int64), phrase.view(np.int64), text, first - (ends - sizes)[text], count


def _parse(size: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}  # by text: its hashes, row, whether it came twice
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            again = np.array([e[3] for _, e in items], bool)
            tks, tjs, rks = (np.array([e[k] for _, e in items], np.int64) for k in range(3))
            pieces = [(i, b, t[b : b + STRETCH + size - 1]) for i, (t, _) in enumerate(items) for b in range(0, len(t) - size + 1, STRETCH)]
            parsed, b = [], 0
            while b < len(pieces) or not parsed:  # places of one parse() fit its keys
                e, room = b + 1, STRETCH
                while e < len(pieces) and (room := room - len(pieces[e - 1][2])) >= len(pieces[e][2]):
                    e += 1
                a, p, piece, s, n = parse([t for _, _, t in pieces[b:e]], size)
                parsed.append((a, p, piece + b, s, n))
                b = e
            a, p, piece, s, n = (np.concatenate(x) for x in zip(*parsed))
            text, s = np.array([i for i, _, _ in pieces])[piece], s + np.array([b for _, b, _ in pieces])[piece]
            if again.any():
                m = np.array([len(t) - size + 1 for t, _ in items], np.int64)[again]
                yield _marks(tks[again], tjs[again], np.zeros(len(m), np.int64), m)
            if not len(a):
                return
            order = np.lexsort((p, a))
            a, p, text, s, n = (x[order] for x in (a, p, text, s, n))
            head = np.append(True, (a[1:] != a[:-1]) | (p[1:] != p[:-1]))
            group = np.cumsum(head) - 1
            twice = (np.bincount(group) > 1) | (np.bincount(group, again[text]) > 0)
            first = a[head]
            bound = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            phrases = np.diff(np.append(bound, len(first)))
            crowd = np.repeat(phrases >= CROWDED, phrases)
            yield _runs(1, first, p[head], twice, tks[text[head]], tjs[text[head]], rks[text[head]], s[head], n[head], crowd)
            if crowd.any():  # a row without windows tells the trigger's own owner, who gets the phrases of other stretches
                none = np.zeros((phrases >= CROWDED).sum(), np.int64)
                yield _runs(1, first[bound[phrases >= CROWDED]], none, none.astype(bool), none, none, none, none, none)
            if (known := twice[group] & ~again[text]).any():
                yield _marks(tks[text[known]], tjs[text[known]], s[known], n[known])

        for batch in batches:
            for tk, tj, rk, t in zip(*(batch[c].to_pylist() for c in ("tk", "tj", "rk")), texts_of(batch["text"])):
                if len(t) < size:
                    continue
                if t in held:
                    held[t][3] = True
                    continue
                if total and total + len(t) > STRETCH:
                    yield from flush()
                    held, total = {}, 0
                held[t] = [tk, tj, rk, False]
                total += len(t)
        if held:
            yield from flush()

    return f


def _marks(tk, tj, s, n) -> pa.RecordBatch:
    none = np.zeros(len(tk), np.int64)
    return _runs(0, none, none, np.zeros(len(tk), bool), np.asarray(tk), np.asarray(tj), none, np.asarray(s), np.asarray(n))


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, a, f). Holds of the trigger at hand its last phrase and whether there were others."""
    last: dict | None = None  # the phrase at hand: its first row, whether it is repeated and marked, whether its trigger had others
    for batch in batches:
        c = {k: batch[k].to_numpy(zero_copy_only=False) for k in ("kind", "a", "f", "twice", "several", "tk", "tj", "rk", "s", "n")}
        known = c["kind"] == 0
        if known.any():
            yield _marks(*(c[k][known] for k in ("tk", "tj", "s", "n")))
        c = {k: v[~known] for k, v in c.items()}
        if not len(c["a"]):
            continue
        if last is not None:
            c = {k: np.concatenate((last[k], v)) for k, v in c.items()}
        done = last["done"] if last is not None else np.zeros(0, bool)  # its mark is given
        sent = last["sent"] if last is not None else False  # its trigger is known to have several phrases
        a, f = c["a"], c["f"]
        same_a = a[1:] == a[:-1]
        head = np.append(True, ~same_a | (f[1:] != f[:-1]))
        group = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        twice = (np.bincount(group) > 1) | (np.bincount(group, c["twice"]) > 0)
        trigger = np.cumsum(np.append(True, ~same_a)) - 1
        several = (np.bincount(trigger[first]) > 1) | (np.bincount(trigger, c["several"]) > 0)
        if sent:
            several[0] = True
        mark = twice[group]
        mark[: len(done)] &= ~done
        mark &= c["n"] > 0
        if mark.any():
            yield _marks(*(c[k][mark] for k in ("tk", "tj", "s", "n")))
        # all phrases but the last are complete; the last one waits for what comes
        send = first[several[trigger[first]]]
        send = send[(send < first[-1]) & (c["n"][send] > 0)]
        if len(send):
            yield _runs(2, a[send], f[send], twice[group[send]], *(c[k][send] for k in ("tk", "tj", "rk", "s", "n")))
        end = first[-1]
        last = {k: v[end : end + 1] for k, v in c.items()} | {"done": twice[-1:].copy(), "sent": bool(several[-1])}
        last["twice"] = twice[-1:].copy()
    if last is not None and last["sent"] and last["n"][0] > 0:
        yield _runs(2, *(last[k] for k in ("a", "f", "twice", "tk", "tj", "rk", "s", "n")))


def _cut(size: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, runs in zip(texts_of(batch["text"]), batch["runs"].to_pylist()):
                rows += [(r["a"], r["twice"], r["tk"], r["tj"], r["s"], r["n"], t[r["s"] : r["s"] + r["n"] - 1 + size]) for r in runs]
                if len(rows) > 5000:
                    yield _cuts(rows)
                    rows = []
            yield _cuts(rows)

    return f


def _cuts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["a", "twice", "tk", "tj", "s", "n", "bytes"])


def _mark_rows(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["tk", "tj", "s", "n"])


def _order(size: int):
    """Rows sorted by trigger: puts blocks of whole triggers in corpus order and marks what two places share."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        total, at = 0, None

        def flush() -> pa.RecordBatch:
            items = [(k, 0, r[5]) for k, r in enumerate(rows)] if len(rows) <= CROWD else crowd(rows)
            same: dict[bytes, list[tuple[int, int, int]]] = {}
            for k, b, n in items:
                same.setdefault(rows[k][6][b : b + n - 1 + size], []).append((k, b, n))
            distinct = list(same)
            found, out, at = repeated(distinct, [len(t) - size + 1 for t in distinct], size), [], 0
            for t in distinct:
                hit = found[at : at + len(t) - size + 1] | (len(same[t]) > 1)
                at += len(hit)
                if hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).reshape(-1, 2)
                    out += [(rows[k][2], rows[k][3], rows[k][4] + b + int(x), int(y - x)) for k, b, _ in same[t] if not rows[k][1] for x, y in edge]
            return _mark_rows(out)

        def crowd(rows: list[tuple]) -> list[tuple[int, int, int]]:
            """Runs of the windows that have an equal hash: row, first window and windows."""
            n, length = np.array([r[5] for r in rows]), np.array([len(r[6]) for r in rows])
            of = np.repeat(np.arange(len(rows)), n)
            inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            start = (np.cumsum(length) - length)[of] + inner
            h = Rolling(np.frombuffer(b"".join(r[6] for r in rows), np.uint8)).of(start, start + size)
            order = np.argsort(h)
            equal = h[order[1:]] == h[order[:-1]]
            some = np.zeros(len(h), bool)
            some[order[1:][equal]] = some[order[:-1][equal]] = True
            at = np.flatnonzero(some)
            if not len(at):
                return []
            head = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (of[at[1:]] != of[at[:-1]])))
            return list(zip(of[at[head]].tolist(), inner[at[head]].tolist(), np.diff(np.append(head, len(at))).tolist()))

        for batch in batches:
            for r in zip(*(batch[c].to_pylist() for c in ("a", "twice", "tk", "tj", "s", "n", "bytes"))):
                if r[0] != at and total > BLOCK_BYTES:
                    yield flush()
                    rows, total = [], 0
                at = r[0]
                rows.append(r)
                total += len(r[6])
        if rows:
            yield flush()

    return f


def _windows(size: int):
    """Every window of the phrases, by two hashes."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch["bytes"].to_pylist()
            if not data:
                continue
            n = batch["n"].to_numpy()
            length = np.array([len(t) for t in data])
            start = np.repeat(np.cumsum(length) - length, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            joined = b"".join(data)
            hashes, one = Rolling(np.frombuffer(joined, np.uint8)), np.ones(n.sum(), np.int64)
            other = np.array([xxh3_64_intdigest(joined[b : b + size]) for b in start.tolist()], np.uint64)
            pick = lambda c: np.repeat(batch[c].to_numpy(zero_copy_only=False), n)
            s = pick("s") + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield _runs(1, hashes.of(start, start + size).view(np.int64), other.view(np.int64), pick("twice"), pick("tk"), pick("tj"), one * 0, s, one)

    return f


def _spans(size: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, runs in zip(batch["id"].to_pylist(), texts_of(batch["text"]), batch["runs"].to_pylist()):
                spans: list[list[int]] = []
                for r in sorted(runs or [], key=lambda r: r["s"]):
                    b, e = r["s"], r["s"] + r["n"] - 1 + size
                    if spans and b <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([b, e])
                edge = [0, *(x for s in spans for x in s), len(t)]
                kept = b"".join(t[b:e] for b, e in zip(edge[::2], edge[1::2]))
                out.append((i, len(t), [b for b, _ in spans], [e for _, e in spans], kept))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["id", "n_bytes", "starts", "ends", "kept"])

    return f


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two hashes of a text with different seeds: what marks are joined by."""
    return F.xxhash64(text).alias("tk"), F.xxhash64(F.lit(1), text).alias("tj")


def marks(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of repeated windows by text: tk, tj (hashes of the text), s (first window's start), n (windows)."""
    text = whole_text(text_col)
    keyed = docs.select(*text_keys(text), row_key(id_col, text_col).alias("rk"), text.alias("text"))
    parsed = map_batches(keyed, _parse(size), RUNS).repartition(partitions(docs.sparkSession), "deal")
    runs = staged(map_batches(parsed.sortWithinPartitions("kind", "a", "f"), _own, RUNS), "repeat-runs")
    known = runs.where("kind = 0").select("tk", "tj", "s", "n")
    several = runs.where("kind = 2").groupBy("rk").agg(F.collect_list(F.struct("a", "twice", "tk", "tj", "s", "n")).alias("runs"))  # bounded by the text's length
    phrases = staged(map_batches(keyed.select("rk", "text").join(several, "rk").select("text", "runs"), _cut(size), CUT), "repeat-phrases")
    crowded = phrases.groupBy("a").agg(F.count("*").alias("phrases")).where(F.col("phrases") > BLOCK_PHRASES).select("a")
    blocks = phrases.join(crowded, "a", "left_anti").repartition(partitions(docs.sparkSession), "a").sortWithinPartitions("a")
    ordered = map_batches(blocks, _order(size), MARKS)
    alone = map_batches(phrases.join(crowded, "a", "left_semi"), _windows(size), RUNS).repartition(partitions(docs.sparkSession), "a")
    dealt = map_batches(alone.sortWithinPartitions("a", "f"), _own, RUNS).where("kind = 0").select("tk", "tj", "s", "n")
    return staged(known.unionByName(ordered).unionByName(dealt), "repeat-marks")


def without_repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, starts and ends of the removed runs, kept (bytes)."""
    found = marks(docs, size, id_col, text_col).groupBy("tk", "tj").agg(F.collect_set(F.struct("s", "n")).alias("runs"))
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *text_keys(text))
    return map_batches(rows.join(found, ["tk", "tj"], "left").select("id", "text", "runs"), _spans(size), "id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary")


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate(F.zip_with("starts", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda x, y: x + y)
    return rows.select(F.col("id").alias(id_col), "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_repeats(spark, sf_dir: str) -> DataFrame:
    return digest(without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, k, md5(b[k + 1 : k + 200]) AS h FROM (SELECT r, b, unnest(range(0, greatest(octet_length(b) - 199, 0))) AS k FROM d)),
m AS (SELECT r, k FROM w WHERE h IN (SELECT h FROM w GROUP BY 1 HAVING count(*) > 1)),
i AS (SELECT r, k, sum(fresh) OVER (PARTITION BY r ORDER BY k) AS run FROM (SELECT r, k, CAST(coalesce(k > lag(k) OVER (PARTITION BY r ORDER BY k) + 200, true) AS INTEGER) AS fresh FROM m)),
s AS (SELECT r, min(k) AS b, max(k) + 200 AS e FROM i GROUP BY r, run),
g AS (SELECT r, e AS b, coalesce(lead(b) OVER (PARTITION BY r ORDER BY b), 1000000000000) AS e FROM s UNION ALL SELECT r, 0, min(b) FROM s GROUP BY r),
kept AS (SELECT g.r, string_agg(hex(d.b[g.b + 1 : least(g.e, octet_length(d.b))]), '' ORDER BY g.b) AS x FROM g JOIN d ON g.r = d.r WHERE g.e > g.b AND g.b < octet_length(d.b) GROUP BY 1),
n AS (SELECT r, count(*) AS spans, sum(e - b) AS removed FROM s GROUP BY 1)
SELECT doc_id, CAST(octet_length(d.b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       CASE WHEN n.r IS NULL THEN sha256(d.b) ELSE sha256(unhex(coalesce(x, ''))) END AS kept_sha256
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN kept ON kept.r = d.r
"""
