"""Near duplicates by an n-gram Jaccard join with grouped prefixes.

A document's set is that of its distinct word shingles, as 64-bit hashes. All shingles stand in one order:
those not known to be frequent first, by hash, then the frequent ones by count. Any fixed order gives right results; this one
keeps passages that many documents share out of the prefixes. Two sets with Jaccard similarity t or more share a
shingle within their first n - ceil(t * n) + 1, and at the first shared one enough of either set must be left.

Texts are cut into shingles anew for each of four passes, as sets of hashes take twice the room of texts and prefixes half of it: to count frequent shingles, for
sizes and groups, for prefixes, and for the sets of those documents that any pair could have.

1. Documents with equal sets form a class; classes with the same prefix and size form a group. Only groups
   enter the buckets of the prefix shingles.
2. Star rounds: each bucket pairs its groups with the one that has most left behind the shingle; each group keeps the partner
   it meets most often and the one with most left, and (in the first round) pairs its members with its first. The pairs are
   verified on the sets (after a sketch of odd counts has bounded their difference); links give components, and the next
   round looks only across them.
3. Last, each bucket pairs all groups that are not in one component yet and pass the filters of size and position. A bucket of more
   than BLOCK groups is cut into blocks, and pairs of blocks are dealt to tasks; groups of the bucket's largest component have blocks of their own, which are never
   paired with each other.
   Group pairs are expanded to blocks of members, whose sketches are compared before a pair of members is passed on to be
   verified. What is never verified is in one component already. So no
   link between components is lost, and a large group of copies never gives all its pairs.

Edge cases. Null text is empty; texts without words have an empty set and are linked with nothing. Texts with
fewer words than a shingle have their whole sequence as one shingle. Rows that repeat an id or a text are rows of one class. An empty
table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, partitions, parts_for, small_side, staged, texts_of, whole_text, without
from .components import merged
from .pfp import mixed
from .words import word_hashes

WORDS, PERCENT = 5, 80
#: Shingles in the table of frequent ones, which is sent to all tasks (16 bytes each), and bytes of sets within which a shingle is seen to repeat.
FREQUENT, STRETCH = 1 << 18, 12 << 20
#: Count from which the histogram of counts has SCALE bins to the octave instead of one for each count.
EXACT_COUNTS, SCALE = 1 << 16, 16

#: Rounds in which groups look for a component through one or two partners each, before all pairs across components are looked at.
ROUNDS = 2
#: Prefix shingles to a part, and those of one part beyond which they are passed on as they are.
PART_TOKENS, LOOSE = 1 << 19, 1 << 22
#: Groups of a bucket up to which each must fit another one to stay; larger buckets stay as they are.
SMALL_BUCKET = 64
#: Groups of a bucket, and members of a group, that one task compares at once with others.
BLOCK, MEMBERS = 256, 256

#: Bits of the sketch of a set: one each for an odd number of shingles with that hash.
SKETCH = 2048

SETS = "doc_id bigint, rk bigint, h bigint, n int, fp bigint, gid bigint"
TOKENS = "part int, tokens binary, at binary, pos binary, gids binary, sizes binary"
ROWS = "token bigint, gid bigint, n int, pos int"
PAIR = "u bigint, v bigint"


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted unsigned hashes."""
    word, counts = word_hashes(texts)
    bound = np.append(0, np.cumsum(counts))
    mixes = [np.uint64(int(mixed(np.array([k + 1], np.uint64))[0]) | 1) for k in range(words)]
    runs = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        runs += word[k : k + len(runs)] * mixes[k]
    runs, out = mixed(runs), []
    for b, e in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if e - b >= words:
            out.append(np.unique(runs[b : e - words + 1]))
        elif e > b:
            out.append(mixed(np.array([sum(int(w) * int(m) for w, m in zip(word[b:e], mixes)) + e - b & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _hashed(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _frequent(words: int, stretch: int):
    """Shingles that several sets of a stretch have, and how many have them."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = np.sort(np.concatenate(held))
            head = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
            count = np.diff(np.append(head, len(found)))
            return pa.RecordBatch.from_arrays([pa.array(found[head[count > 1]].view(np.int64)), pa.array(count[count > 1], pa.int64())], ["h", "c"])

        for batch in batches:
            sets = [x for x in shingles(texts_of(batch["text"]), words) if len(x)]
            held += sets
            size += sum(x.nbytes for x in sets)
            if size > stretch:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return f


def _prefix(x: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, int]:
    """The first shingles of a set, and the id of its group: a hash of them and the size."""
    hashes, counts = frequent
    often = np.zeros(len(x), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, x), len(hashes) - 1)
        often = np.where(hashes[at] == x, counts[at], 0)
    first = x[np.argsort(often, kind="stable")[: prefix_size(len(x), percent)]]
    return first, _digest(first, len(x))


def _digest(x: np.ndarray, seed: int = 0) -> int:
    place = mixed(np.arange(1, len(x) + 1, dtype=np.uint64)) | np.uint64(1)
    return int(mixed(np.array([(x * place).sum() + np.uint64(seed)], np.uint64)).view(np.int64)[0])


def _sets(words: int, percent: int, frequent):
    """Each set's size, digest and group."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rks, sets = batch["rk"].to_pylist(), shingles(texts_of(batch["text"]), words)
            fps = [_digest(x) if len(x) else rk for rk, x in zip(rks, sets)]
            gids = [_prefix(x, frequent.value, percent)[1] if len(x) else rk for rk, x in zip(rks, sets)]
            columns = [batch["id"], batch["rk"], batch["h"], pa.array([len(x) for x in sets], pa.int32()), pa.array(fps, pa.int64()), pa.array(gids, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SETS.split(", ")])

    return f


def _tokens(words: int, percent: int, frequent, parts: int):
    """Prefix shingles dealt by hash, packed: one row per stretch and part."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int]] = {}
        total = 0

        def flush() -> pa.RecordBatch:
            gids, sizes = np.array(list(held), np.int64), np.array([n for _, n in held.values()], np.int32)
            lengths = [len(x) for x, _ in held.values()]
            token = np.concatenate([x for x, _ in held.values()])
            at, pos = np.repeat(np.arange(len(gids), dtype=np.int32), lengths), np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
            part = (token >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            order = np.lexsort((token, part))
            token, at, pos, part = token[order], at[order], pos[order], part[order]
            head = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            rows = []
            for b, e in zip(head.tolist(), [*head[1:].tolist(), len(part)]):
                own, near = np.unique(at[b:e], return_inverse=True)
                rows.append((int(part[b]), token[b:e].tobytes(), near.astype(np.int32).tobytes(), pos[b:e].tobytes(), gids[own].tobytes(), sizes[own].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k in range(6)], [c.split()[0] for c in TOKENS.split(", ")])

        for batch in batches:
            for x in shingles(texts_of(batch["text"]), words):
                if len(x):
                    first, gid = _prefix(x, frequent.value, percent)
                    if gid not in held:
                        held[gid] = first, len(x)
                        total += len(first)
            if total > STRETCH >> 4:
                yield flush()
                held, total = {}, 0
        if held:
            yield flush()

    return f


def _buckets(percent: int):
    """Rows sorted by part: of every part, the buckets in which groups fit each other."""

    def bucket(rows: list[dict], loose: bool) -> pa.RecordBatch:
        token = np.concatenate([np.frombuffer(r["tokens"], np.int64) for r in rows])
        at = [np.frombuffer(r["at"], np.int32) for r in rows]
        gid = np.concatenate([np.frombuffer(r["gids"], np.int64)[a] for r, a in zip(rows, at)])
        n = np.concatenate([np.frombuffer(r["sizes"], np.int32)[a] for r, a in zip(rows, at)])
        pos = np.concatenate([np.frombuffer(r["pos"], np.int32) for r in rows])
        order = np.lexsort((gid, token))
        token, gid, n, pos = token[order], gid[order], n[order], pos[order]
        new = np.append(True, (token[1:] != token[:-1]) | (gid[1:] != gid[:-1]))
        token, gid, n, pos = token[new], gid[new], n[new], pos[new]
        if loose:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (token, gid, n, pos)], ["token", "gid", "n", "pos"])
        head = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.repeat(np.diff(np.append(head, len(token))), np.diff(np.append(head, len(token))))
        keep = size > SMALL_BUCKET
        for d in range(1, SMALL_BUCKET):  # neighbours at each distance
            i = np.flatnonzero((token[d:] == token[:-d]) & (size[d:] <= SMALL_BUCKET))
            if not len(i):
                break
            i = i[_fits(n[i], pos[i], n[i + d], pos[i + d], percent)]
            keep[i] = keep[i + d] = True
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, gid, n, pos)], ["token", "gid", "n", "pos"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held, loose = 0, False  # loose: the part at hand is too large to be held, so its rows go on unfiltered
        for batch in batches:
            for r in batch.to_pylist():
                if rows and (r["part"] != rows[0]["part"] or held > LOOSE):
                    same = r["part"] == rows[0]["part"]
                    yield bucket(rows, loose or same)
                    rows, held, loose = [], 0, same
                rows.append(r)
                held += len(r["tokens"]) >> 3
        if rows:
            yield bucket(rows, loose)

    return f


def _columns(batch: pa.RecordBatch, names: str) -> dict[str, np.ndarray]:
    return {c: batch[c].to_numpy(zero_copy_only=False) for c in names.split()}


def _fits(n1, pos1, n2, pos2, percent: int):
    """Could sets of these sizes, whose first shared shingles have these places, be similar enough?"""
    need = -(-percent * (n1 + n2) // (100 + percent))
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (n1 - pos1 >= need) & (n2 - pos2 >= need)


def _pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), 1), axis=0) if len(u) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


def _fit(a: str, b: str, percent: int) -> Column:
    """_fits() of two rows' n and pos, as a column."""
    n, m = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    need = F.ceil((n + m) * percent / (100 + percent))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (n - F.col(f"{a}.pos") >= need) & (m - F.col(f"{b}.pos") >= need)


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """rows: token, gid, n, pos, label. The group of each bucket with most left behind the shingle, with each other one of another label: u, v, rest.

    The first of a bucket is an aggregate and comes back by a join, so that adaptive execution may split a crowded bucket.
    """
    centre = rows.groupBy("token").agg(F.count("*").alias("many"), F.max(F.struct((F.col("n") - F.col("pos")).alias("rest"), "gid", "n", "pos", "label")).alias("c"))
    centre = centre.where("many > 1").select("token", "c.*")
    both = rows.alias("a").join(centre.alias("c"), "token").where((F.col("a.gid") != F.col("c.gid")) & ((F.col("a.label") != F.col("c.label")) | (F.col("a.label") == 0)) & _fit("c", "a", percent))
    return both.select(F.least("a.gid", "c.gid").alias("u"), F.greatest("a.gid", "c.gid").alias("v"), "c.rest")


def _across(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None, percent: int, block: int = 256) -> Iterator[pa.RecordBatch]:
    """Pairs of groups of a, or of a and b, that fit and don't have one label. label 0: a group whose members have several."""
    if b is None:
        order = np.argsort(a["n"], kind="stable")
        a = {k: v[order] for k, v in a.items()}
    other = a if b is None else b
    for k in range(0, len(a["n"]), block):
        i = np.arange(k, min(k + block, len(a["n"])))
        ok = (a["label"][i][:, None] != other["label"]) | (other["label"] == 0)
        ok &= _fits(a["n"][i][:, None], a["pos"][i][:, None], other["n"], other["pos"], percent)
        if b is None:
            ok &= np.arange(len(a["n"])) > i[:, None]
        x, y = np.nonzero(ok & (a["gid"][i][:, None] != other["gid"]))
        if len(x):
            yield _pairs(a["gid"][i[x]], other["gid"][y])


def _cells(percent: int):
    """Rows sorted by token, cell (a, b) and side: pairs within a block (a = b), and across two."""
    key, names = ("token", "a", "b"), ("token", "a", "b", "side", "gid", "n", "pos", "label")

    def cell(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        c = {k: np.concatenate([x[k] for x in parts]) for k in names}
        x, y = ({k: c[k][c["side"] == s].astype(np.int64) for k in ("gid", "n", "pos", "label")} for s in (0, 1))
        if c["a"][0] == c["b"][0]:
            yield from _across(x, None, percent)
        elif len(x["n"]) and len(y["n"]):
            yield from _across(x, y, percent)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []  # of the cell at hand
        for batch in batches:
            if not batch.num_rows:
                continue
            c = _columns(batch, " ".join(names))
            new = np.zeros(batch.num_rows, bool)
            for k in key:
                new[1:] |= c[k][1:] != c[k][:-1]
            head = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for b, e in zip(head, head[1:]):
                part = {k: v[b:e] for k, v in c.items()}
                if held and any(held[0][k][0] != part[k][0] for k in key):
                    yield from cell(held)
                    held = []
                held.append(part)
        if held:
            yield from cell(held)

    return f


def _crossed(rows: DataFrame, percent: int, block: int | None = None) -> DataFrame:
    """rows: token, gid, n, pos, label (staged). All pairs of groups of a bucket that fit and aren't in one component: u, v.

    A bucket of at most a block is one cell, held by one task. In a larger one, groups of the largest component are dealt to `major` blocks and all others to
    `minor` blocks; cells are the pairs of minor blocks and those of a major with a minor one. Each row goes to all of its cells.
    """
    block = BLOCK if block is None else block
    by = rows.groupBy("token", "label").agg(F.count("*").alias("c"))
    own = F.when(F.col("label") != 0, F.struct("c", "label"))
    about = by.groupBy("token").agg(F.sum("c").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(own).alias("most"))
    about = about.where((F.col("m") > 1) & ((F.col("lo") != F.col("hi")) | (F.col("lo") == 0)))
    crowded, most = F.col("m") > block, F.coalesce("most.c", F.lit(0))
    blocks = lambda c: F.when(crowded, F.ceil(c / block)).otherwise(F.lit(0)).cast("int")
    about = about.select("token", F.when(crowded, F.col("most.label")).alias("largest"), blocks(most).alias("major"), blocks(F.col("m") - most).alias("minor"))
    dealt = rows.join(about, "token")
    is_major = F.coalesce(F.col("label") == F.col("largest"), F.lit(False))
    number = lambda n: F.pmod(F.xxhash64("gid"), F.greatest(F.col(n), F.lit(1))).cast("int")
    dealt = dealt.withColumns({"is_major": is_major, "at": F.when(is_major, number("major")).otherwise(number("minor"))})
    # a cell: blocks a and b, minor ones from 0, major ones below 0 and never with each other; side: which of the two the row is in
    cell = lambda a, b, side: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(side).alias("side"))
    others = F.sequence(F.lit(0), F.greatest("minor", F.lit(1)) - 1)
    majors = F.when(F.col("major") > 0, F.sequence(F.lit(1), F.col("major"))).otherwise(F.array().cast("array<int>"))
    of_major = F.transform(others, lambda j: cell(-1 - F.col("at"), j, 0))
    of_minor = F.concat(F.transform(others, lambda j: F.when(j < F.col("at"), cell(j, F.col("at"), 1)).otherwise(cell(F.col("at"), j, 0))), F.transform(majors, lambda i: cell(-i, F.col("at"), 1)))
    dealt = dealt.withColumn("cell", F.explode(F.when(F.col("is_major"), of_major).otherwise(of_minor))).select("token", "cell.a", "cell.b", "cell.side", "gid", "n", "pos", "label")
    dealt = dealt.repartition(partitions(rows.sparkSession), "token", "a", "b").sortWithinPartitions("token", "a", "b", "side")
    return map_batches(dealt, _cells(percent), PAIR).distinct()


def _verify(percent: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for u, v, a, b in zip(*(batch[c].to_pylist() for c in ("u", "v", "a", "b"))):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(x) + len(y)
                shared = both - len(np.unique(np.concatenate((x, y))))
                if 100 * shared >= percent * (both - shared):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return f


def _hashes(words: int):
    """Sets with their sketches, each once in a stretch of rows."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fps = batch["fp"].to_pylist()
            new = [k for k, fp in enumerate(fps) if fp not in seen and not seen.add(fp)]
            batch = batch.take(pa.array(new, pa.int64()))
            if len(seen) > STRETCH >> 6:
                seen = set()
            sets = shingles(texts_of(batch["text"]), words)
            odd = [np.packbits(np.bincount((x & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch["fp"], pa.array([len(x) for x in sets], pa.int32()), pa.array(odd, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["fp", "n", "odd", "hashes"])

    return f


def _possible(percent: int):
    """Pairs whose sets can be similar enough: bits of odd counts that differ are at most as many as differing shingles."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("a", "b"))
            both = batch["m"].to_numpy().astype(np.int64) + batch["n"].to_numpy()
            ok = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) * (100 + percent) <= (100 - percent) * both
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], ["u", "v"]).filter(pa.array(ok))

    return f


def _possible_members(percent: int):
    """Rows of two blocks of members (fu, lu, ou, fv, lv, ov: lists; n, m: sizes): pairs of members in two components that can be similar enough."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for r in range(batch.num_rows):
                fu, lu, fv, lv = (np.asarray(batch[c][r].values) for c in ("fu", "lu", "fv", "lv"))
                ou, ov = (np.frombuffer(b"".join(batch[c][r].as_py()), np.uint64).reshape(-1, SKETCH // 64) for c in ("ou", "ov"))
                both = (batch["n"][r].as_py() + batch["m"][r].as_py()) * (100 - percent)
                for k in range(0, len(fu), 64):
                    ok = np.bitwise_count(ou[k : k + 64, None] ^ ov).sum(2, dtype=np.int64) * (100 + percent) <= both
                    x, y = np.nonzero(ok & (lu[k : k + 64, None] != lv))
                    us.append(fu[k + x])
                    vs.append(fv[y])
            yield _pairs(np.concatenate(us), np.concatenate(vs))

    return f


def _group_labels(member: DataFrame) -> DataFrame:
    """The component of each group's members, or 0 if they are in several."""
    return member.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high")).select("gid", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(0)).alias("label"))


def frequent_shingles(texts: DataFrame, words: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """About so many shingles at most (a quarter more by chance), those with the highest counts, sorted by hash, and their counts.

    Of the shingles in the bin of counts that no longer fits, those with the least hashes are taken, so the table is never
    empty where shingles repeat, however often.
    """
    most = FREQUENT if most is None else most
    counted = staged(map_batches(texts.select("text"), _frequent(words, STRETCH), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")), "frequent")
    bin_of = F.when(F.col("c") < EXACT_COUNTS, F.col("c")).otherwise(EXACT_COUNTS + F.floor(F.log2(F.col("c") / EXACT_COUNTS) * SCALE)).cast("long")
    binned, least, total, share = counted.withColumn("bin", bin_of), 1 << 62, 0, 0.0
    for r in binned.groupBy("bin").count().orderBy(F.desc("bin")).toLocalIterator():
        if total + r["count"] > most:
            share = (most - total) / r["count"]
            break
        least, total = r.bin, total + r["count"]
    below = F.lit(min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64))))
    last = binned.where((F.col("bin") < least) & (F.col("h") < below)).agg(F.max("bin")).first()[0] if share else None
    rows = binned.where((F.col("bin") >= least) | ((F.col("bin") == F.lit(last).cast("long")) & (F.col("h") < below))).select("h", "c").toPandas()
    h, c = rows["h"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (the least id that links reach, its own included)."""
    return _components(docs, words, percent, id_col, text_col).select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def kept_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which one per component stays: that with the least id.

    Of several texts with that id, the one with the least row key; rows that repeat id and text stay or go together.
    """
    rows = staged(_components(docs, words, percent, id_col, text_col), "near-components")
    at_least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = rows.where(at_least & (F.col("n") > 0)).groupBy("component_id").agg(F.min("rk").alias("first"))
    found = rows.where("n > 0").join(first, "component_id")
    return without(docs, found.where(~at_least | (F.col("rk") != F.col("first"))).select("rk", "h"), id_col, text_col)


def _components(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, rk, h, n, component_id."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), whole_text(text_col)).alias("rk"), F.xxhash64(whole_text(text_col)).alias("h"), whole_text(text_col).alias("text"))
    often = spark.sparkContext.broadcast(frequent_shingles(keyed, words))
    sets = staged(map_batches(keyed, _sets(words, percent, often), SETS), "shingle-sets")
    classes = staged(sets.where("n > 0").groupBy("fp", "n").agg(F.min("doc_id").alias("doc"), F.min("rk").alias("rk"), F.min("gid").alias("gid")), "shingle-classes")
    groups = staged(classes.groupBy("gid").agg(F.min("fp").alias("rep"), F.count("*").alias("members"), F.first("n").alias("n")), "shingle-groups")
    expected = groups.agg(F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n").cast("long") * percent / 100) + 1), F.lit(0)).cast("long")).first()[0]
    parts = parts_for(spark, expected, PART_TOKENS, 4)
    packed = map_batches(keyed.select("text"), _tokens(words, percent, often, parts), TOKENS)
    rows = staged(map_batches(packed.repartition(-(-parts // 4), "part").sortWithinPartitions("part"), _buckets(percent), ROWS), "shingle-buckets")

    # sets and sketches of all classes that can be in a pair
    paired = rows.select("gid").unionByName(groups.where("members > 1").select("gid")).distinct()
    wanted = staged(classes.join(paired, "gid").select("fp", "rk"), "shingle-wanted")
    hashes = staged(map_batches(keyed.select("rk", "text").join(small_side(wanted), "rk").select("fp", "text"), _hashes(words), "fp bigint, n int, odd binary, hashes binary"), "shingle-hashes")
    sketches = hashes.select("fp", "n", "odd")

    def possible(pairs: DataFrame) -> DataFrame:
        a = sketches.select(F.col("fp").alias("u"), F.col("n").alias("m"), F.col("odd").alias("a"))
        b = sketches.select(F.col("fp").alias("v"), "n", F.col("odd").alias("b"))
        return staged(map_batches(pairs.join(a, "u").join(b, "v").select("u", "v", "m", "n", "a", "b"), _possible(percent), PAIR), "possible")

    def verified(pairs: DataFrame) -> DataFrame:
        # rows that repeat a class's id and text may give its set more than once, and so a pair: the links stay the same
        some = hashes.select("fp", "hashes").join(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), "fp", "left_semi")
        a = some.select(F.col("fp").alias("u"), F.col("hashes").alias("a"))
        b = some.select(F.col("fp").alias("v"), F.col("hashes").alias("b"))
        return staged(map_batches(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b"), _verify(percent), PAIR), "links")

    rep = groups.select("gid", "rep")
    member = classes.select("gid", "fp", F.col("fp").alias("label"))
    tried = None
    for k in range(ROUNDS):
        labelled = staged(rows.join(_group_labels(member), "gid"), "labelled")
        stars = _stars(labelled, percent).groupBy("u", "v").agg(F.count("*").alias("c"), F.max("rest").alias("rest"))
        if tried is not None:
            stars = stars.join(tried, ["u", "v"], "left_anti")
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v"), "c", "rest"))
        # each group with the one that it meets in most buckets, and with the one that has most left
        best = both.groupBy("u").agg(F.array(F.max_by("v", F.struct("c", "v")), F.max_by("v", F.struct("rest", "c", "v"))).alias("vs")).select("u", F.explode("vs").alias("v"))
        best = staged(best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "partners")
        tried = best if tried is None else tried.unionByName(best)
        pairs = best.join(rep.select(F.col("gid").alias("u"), F.col("rep").alias("ru")), "u").join(rep.select(F.col("gid").alias("v"), F.col("rep").alias("rv")), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
        if not k:
            pairs = pairs.unionByName(classes.join(groups.where("members > 1").select("gid", "rep"), "gid").where("fp <> rep").select(F.col("rep").alias("u"), F.col("fp").alias("v")))
        member = merged(member, verified(possible(pairs)))

    # all that is left
    one = _group_labels(member)
    crossed = _crossed(staged(rows.join(one, "gid"), "labelled"), percent)
    pairs = staged(crossed.unionByName(one.where("label = 0").select(F.col("gid").alias("u"), F.col("gid").alias("v"))), "group-pairs")
    block = F.pmod(F.xxhash64("fp"), F.ceil(F.col("members") / MEMBERS).cast("long"))
    about = member.join(pairs.select(F.explode(F.array("u", "v")).alias("gid")).distinct(), "gid").join(groups.select("gid", "members"), "gid").join(sketches, "fp")
    blocks = about.withColumn("block", block).groupBy("gid", "block").agg(F.min("n").alias("n"), F.collect_list(F.struct("fp", "label", "odd")).alias("x"))
    blocks = staged(blocks.select("gid", "block", "n", *(F.col(f"x.{c}").alias(c) for c in ("fp", "label", "odd"))), "member-blocks")
    a = blocks.select(F.col("gid").alias("u"), F.col("block").alias("bu"), "n", F.col("fp").alias("fu"), F.col("label").alias("lu"), F.col("odd").alias("ou"))
    b = blocks.select(F.col("gid").alias("v"), F.col("block").alias("bv"), F.col("n").alias("m"), F.col("fp").alias("fv"), F.col("label").alias("lv"), F.col("odd").alias("ov"))
    both = pairs.join(a, "u").join(b, "v").where("u <> v or bu <= bv").select("n", "m", "fu", "lu", "ou", "fv", "lv", "ov")
    more = staged(map_batches(both, _possible_members(percent), PAIR).distinct(), "possible")
    member = merged(member, verified(more))

    named = member.select("fp", "label").join(classes.select("fp", "n", "doc"), "fp")
    low = named.groupBy("label").agg(F.min("doc").alias("component"))
    named = named.join(low, "label").select("fp", "n", F.coalesce("component", "doc").alias("component"))
    return sets.select("doc_id", "rk", "h", "n", "fp").join(named, ["fp", "n"], "left").select("doc_id", "rk", "h", "n", F.coalesce("component", "doc_id").alias("component_id"))


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=4, percent=85)


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 3), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u AS doc_id, v AS other FROM e UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.other = e.u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.other, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS other FROM r GROUP BY 1) m ON m.doc_id = d.doc_id
"""
