"""Sharding, chats, decontamination, SentencePiece, exact dedup: brute force on rows that hold every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evalmill.llm import chat, common, decontaminate, exact_dedup, pieces, sharding

KEY = lambda x: (x is None, x)


def test_differencing():
    rng = random.Random(1)
    assert sharding.differencing([], 4) == [] and sharding.differencing([5], 4) in ([0], [1], [2], [3])
    assert Counter(sharding.differencing([1] * 12, 4)) == {0: 3, 1: 3, 2: 3, 3: 3}
    parts = sharding.differencing([8, 7, 6, 5, 4], 2)
    assert abs(sum(w * (1 - 2 * p) for w, p in zip((8, 7, 6, 5, 4), parts))) == 2  # the known result of differencing
    w = [rng.randint(1, 10_000) for _ in range(3000)]
    sums = Counter()
    for x, p in zip(w, sharding.differencing(w, 16)):
        sums[p] += x
    assert max(sums.values()) - min(sums.values()) <= 5


def test_differencing_of_partial_partitions():
    """Vectors that are partitions themselves; each sum goes to one part, those of one vector to different ones."""
    rng = random.Random(3)
    vectors = [[rng.randint(0, 9000) for _ in range(rng.randint(1, 8))] for _ in range(300)]
    parts, sums = sharding.combined(vectors, 8)
    assert all(len(set(p)) == len(p) == len(v) for p, v in zip(parts, vectors))
    got = Counter()
    for v, p in zip(vectors, parts):
        for x, to in zip(v, p):
            got[to] += x
    assert [got[k] for k in range(8)] == sums and max(sums) - min(sums) <= 50


@pytest.mark.parametrize(("items", "chunk"), [(4, 4096), (4, 3), (1024, 4096), (16, 5)])
def test_shards(docs, hard, none, items, chunk):
    rows = sharding.shard(docs, 4, items=items, chunk=chunk).collect()
    assert len(rows) == len(hard) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    of, slots, sizes, groups = defaultdict(set), defaultdict(list), Counter(), Counter()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in hard), key=lambda x: (KEY(x[0]), x))
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=lambda x: (KEY(x[0]), x)) == want
    for r in rows:
        of[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        groups[r.text_crc32] += r["size"]
    assert all(len(s) == 1 for s in of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # one group holds most bytes: a shard of its own; the others are as even as differencing in one heap makes them
    most = groups.most_common(1)[0][1]
    rest = sorted(sizes.values())
    assert rest[-1] == most and rest[-2] - rest[0] <= 5000  # a chunk of three groups misses by kilobytes
    assert sharding.shard(none).count() == 0


def test_quotas_fill_up_to_one_level():
    assert sharding.quotas([0, 0, 0], 9) == [3, 3, 3] and sharding.quotas([10, 0, 0], 4) == [0, 2, 2]
    assert sharding.quotas([10, 4, 0], 6) == [0, 1, 5] and sharding.quotas([5, 5], 0) == [0, 0] and sharding.quotas([7], 5) == [5]


def test_shards_of_many_groups_are_even(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, "x" * rng.randint(0, 4000) + str(i)) for i in range(3000)], "doc_id long, text string").repartition(3)
    for items, chunk in ((8, 50), (1024, 4096)):
        sizes = [r.s for r in sharding.shard(docs, 16, items=items, chunk=chunk).groupBy("shard").agg({"size": "sum"}).toDF("shard", "s").collect()]
        assert len(sizes) == 16 and max(sizes) - min(sizes) <= 500


def hold_exact(rows, hard):
    groups = defaultdict(list)
    for i, t in hard:
        groups[t or ""].append(i)
    assert len(rows) == len(hard)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    kept = Counter()
    for r in rows:
        ids = groups[sha[r.text_sha256]]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    return groups


@pytest.mark.parametrize(("collapse", "owner_bytes", "lookup_rows", "broadcast"), [(32 << 20, 16 << 20, 1 << 16, 1 << 20), (2000, 3000, 2, 0)])
def test_exact_dedup(docs, hard, none, monkeypatch, collapse, owner_bytes, lookup_rows, broadcast):
    """Also with map tasks that pass on what they hold, many owners, owners that several tasks look up, and without broadcasts."""
    monkeypatch.setattr(exact_dedup, "COLLAPSE_BYTES", collapse)
    monkeypatch.setattr(exact_dedup, "OWNER_BYTES", owner_bytes)
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    groups = hold_exact(exact_dedup.exact_dedup(docs, capacity=3, owner_bytes=owner_bytes, lookup_rows=lookup_rows).collect(), hard)
    left = exact_dedup.kept_rows(docs)
    assert left.columns == docs.columns and sorted(r.text or "" for r in left.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.kept_rows(none).count() == 0


def test_hot_owners_are_looked_up_in_shares(spark):
    rows = [(i, "one text that most rows share" if i % 3 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    index = exact_dedup.build_index(docs, lookup_rows=300)
    assert max(r.copies for r in index.hot.collect()) >= 3
    hold_exact(exact_dedup.exact_dedup(docs, lookup_rows=300).collect(), rows)


def test_lookup_goes_through_directory_and_bucket(docs):
    """Slots that point elsewhere find nothing or the wrong bucket; without them a row is not found."""
    from pyspark.errors import PythonException
    from pyspark.sql import functions as F

    index = exact_dedup.build_index(docs, capacity=2)
    heads = index.rows.where("kind = 0")
    assert heads.where("depth > 0").count() > 0 and index.entries().where("bucket > 0").count() > 0
    assert exact_dedup.look_up(docs, index).count() == docs.count()
    index.rows = index.rows.withColumn("slots", F.when(F.col("kind") == 0, F.reverse("slots").cast("binary")))
    with pytest.raises(PythonException):
        exact_dedup.look_up(docs, index).collect()
    # a row's result is that of the bucket it is led to, not of a join
    index = exact_dedup.build_index(docs, capacity=2)
    index.rows = index.rows.withColumn("group_size", F.when(F.col("kind") == 1, F.col("bucket").cast("long")))
    got = {r.sha: r.group_size for r in exact_dedup.look_up(docs, index).collect()}
    assert got == {r.sha: r.bucket for r in index.entries().collect()}


def test_owner_columns_are_exact(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    edge = [-(1 << 63), (1 << 63) - 1, 0, -1, 1, *(rng.getrandbits(64) - (1 << 63) for _ in range(500))]
    for owners in (1, 3, 16, 1000, 999_983):
        edge += [min(max((o << 64) // owners - (1 << 63) + d, -(1 << 63)), (1 << 63) - 1) for o in range(1, 4) for d in (-1, 0, 1)]
        want = [exact_dedup.owner_key(h, owners)[0] for h in edge]
        assert exact_dedup._owners_of(np.array(edge, np.int64), owners).tolist() == want
        df = spark.createDataFrame([(h,) for h in edge], "h long")
        assert [r.o for r in df.select(exact_dedup._owner_column(F.col("h"), owners).alias("o")).collect()] == want


def test_exact_dedup_chains_equal_hashes():
    """Entries of one hash with other bytes stay apart."""
    import pyarrow as pa

    batch = exact_dedup._entries({b"a": [5, 1, 1, 1], b"b": [5, 9, 1, 2]}, 4)
    again = exact_dedup._entries({b"a": [5, 3, 1, 1]}, 4)
    table = pa.Table.from_batches([*batch, *again])
    out = [r for r in pa.Table.from_batches(exact_dedup._own(4, 8)(iter(table.to_batches()))).to_pylist() if r["kind"] == 1]
    assert {(r["keep_id"], r["group_size"]) for r in out} == {(3, 2), (9, 2)} and {r["chain"] for r in out} == {0, 1}


ITEMS = [(1, "Alpha1 beta2, gamma3 delta4 a b c d e f g h"), (2, "two WORDS"), (3, ""), (4, None), (5, "Alpha1 beta2, gamma3 delta4 a b c d e f g h"), (10, "x y z x y z x y z x y z"), (None, "one"), (None, "two WORDS")]


def contaminated(docs, items, n):
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(table))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            wins[tuple(w[k : k + n])] |= {i} - {None}  # an item without an id hits, but isn't listed
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (own := wins.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda r: (KEY(r[0]), r))


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_decontamination(spark, hard, block):
    more = [*hard, (200, "pre alpha1 BETA2--gamma3 (delta4) A b c d e f g h post"), (201, "Two\twords. two words"), (202, "x y z " * 9)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in more], "doc_id long, text string, items string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.contamination(docs, items, block_bytes=block)
    got = sorted((tuple(r) for r in decontaminate.digest(found).collect()), key=lambda r: (KEY(r[0]), r))
    assert got == contaminated(more, ITEMS, 10) and sum(r[5] for r in got) >= 3
    one = found.where("id = 200").first()
    text = more[-3][1].encode()
    assert [text[b:e] for b, e in zip(one.starts, one.ends)][0].startswith(b"alpha1 BETA2--gamma3 (delta4) A b")
    left = decontaminate.clean_rows(docs, items, block_bytes=block)
    assert left.columns == docs.columns and left.count() == sum(not r[5] for r in got)
    assert decontaminate.digest(decontaminate.contamination(docs.limit(0), items)).count() == 0
    assert not decontaminate.digest(decontaminate.contamination(docs, items.limit(0))).where("contaminated").count()


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces.model_path())


def test_pieces_equal_the_library(docs, hard, none, library):
    rows = pieces.encoded(docs, pieces.model_path()).collect()
    want = Counter()
    for i, t in hard:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i, tuple(ids), library.decode(ids)] += 1
    import numpy as np

    assert Counter((r.id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.decoded) for r in rows) == want
    assert pieces.digest(pieces.encoded(none, pieces.model_path())).count() == 0


def test_the_cache_starts_anew(hard, library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_RUNS", 50)
    model = pieces.Pieces(pieces.model_path())
    for _, t in hard:
        assert model.encode(t or "")[0].tolist() == library.encode(t or "", add_bos=True, add_eos=True)
    assert len(model.cache) <= 50


def test_a_word_is_merged_once_whatever_marks_stand_beside_it(library):
    """Runs end where no piece crosses, so words with other marks and lines behind them are no new runs."""
    model = pieces.Pieces(pieces.model_path())
    text = " ".join(f"wobblish{mark}" for mark in ("", ".", ",", "!!", "$$$", ").", "7", "7:30", ".\nAs", "\n\n", "&&&", "?", '",'))
    assert model.encode(text)[0].tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert sum("wobblish" in run for run in model.cache) == 1
    rng = random.Random(9)
    every = sorted({c for p in model.ids for c in p if c != "▁"})
    for _ in range(3000):
        text = "".join(rng.choice((" ", "ing", "der", "\n", "漢", "\0", rng.choice(every), rng.choice(every), rng.choice("(){}[]^-\\\"'.,;:/_=*#$"))) for _ in range(rng.randint(0, 40)))
        assert model.encode(text)[0].tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_spans_cover_the_text(hard, library):
    model = pieces.Pieces(pieces.model_path())
    rng = random.Random(4)
    odd = ["".join(rng.choice(" ▁aé日😀\n\t\0the") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for text in [t for _, t in hard if t] + odd:
        ids, spans = model.encode(text)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True)
        raw, at = text.encode(), 0
        for (b, e), before in zip(spans.tolist()[1:], [[0, 0], *spans.tolist()[1:]]):
            assert b == at or [b, e] == before or b == e
            at = max(at, e)
        assert at == len(raw)


def test_character_map():
    """A small double array: ab -> X, a -> (nothing), é -> ee."""
    import struct

    keys = {b"ab": b"X", b"a": b"", "é".encode(): b"ee"}
    table, at = b"", {}
    for k, v in keys.items():
        at[k] = len(table)
        table += v + b"\0"
    # units by hand: node ids are xor offsets, each node's children at base ^ label
    units = [0] * 4096
    used = {0}
    base_of = {}

    def place(prefix, node):
        labels = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in keys
        base = next(b for b in range(256, 3000, 256) if b not in base_of.values())
        base_of[prefix] = base
        label = units[node] & 0xFF if prefix else 0
        units[node] = (node ^ base) << 10 | (1 << 8 if leaf else 0) | label
        if leaf:
            units[base] = 1 << 31 | at[prefix]
            used.add(base)
        for c in labels:
            units[base ^ c] = c
            place(prefix + bytes([c]), base ^ c)

    place(b"", 0)
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + table
    normal = pieces.Normalizer(blob, dummy_prefix=True, strip=True)
    text, first, last = normal("  abaéc  d ")
    assert text == "▁Xeec▁d" and first.tolist() == [2, 2, 5, 5, 7, 8, 10] and last.tolist() == [2, 4, 7, 7, 8, 9, 11]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_character_maps_of_the_library(rule):
    """Normalising by the library's own compiled maps: the same text, from the same places."""
    from sentencepiece import SentencePieceNormalizer

    library = SentencePieceNormalizer(rule_name=rule)
    spec = dict(pieces._fields(dict(pieces._fields(library.serialized_model_proto()))[3]))
    own = pieces.Normalizer(spec[2], bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
    assert len(own.map.units) > 10_000
    rng = random.Random(15)
    letters = "aÀéßſİ ﬁﬃ①㍿Ａｂｶﾞ가각　  \t\n½²™…‥日本😀e\u0301o\u0308\u200b\u00ad\ufeffDŽǆΩΩ"
    mapped = 0
    for k in range(1500):
        text = "".join(rng.choice(letters) if rng.random() < 0.7 else chr(rng.choice((rng.randint(0x21, 0x2FF), rng.randint(0x300, 0x36F), rng.randint(0x3040, 0x30FF), rng.randint(0xF900, 0xFAFF), rng.randint(0xFF01, 0xFFEF)))) for _ in range(rng.randint(0, 25)))
        want, places = library.normalize(text, with_offsets=True)
        normal, first, last = own(text)
        assert normal == want, (text, normal, want)
        raw = text.encode()
        assert [len(raw[:b].decode()) for b in first[1:].tolist()] == places[1 : len(want)], text
        assert (first <= last).all() and all(b >= a for a, b in zip(first.tolist(), first[1:].tolist()))
        mapped += normal != "▁" + text
    assert mapped > 500


CHATS = [
    (1, 0, "system", "be <|endoftext|> kind"), (1, 1, "user", "<\\|a\\\\ [INST]"), (1, 2, "assistant", "</s> ok\n\n"), (1, 3, "assistant", " \nagain"), (2, 0, "assistant", None), (2, 1, None, ""),
    (3, 1, "user", "later"), (3, 0, "assistant", "é日本😀" * 30), (3, 0, "assistant", "same turn"), (None, 0, "user", "no id"), (4, None, "assistant", "null turn <<SYS>> <\\s>"), (5, 0, "user", ""),
]


def test_chats(spark):
    turns = spark.createDataFrame([(*r, "x", 1) for r in CHATS], "conv_id long, turn long, role string, text string, formatted string, n_turns int").repartition(4)
    formatted = chat.format_chats(turns, chat.tokenizer_path())
    groups = defaultdict(list)
    for c, n, role, text in sorted(CHATS, key=lambda r: ((r[1] is not None, r[1]), r[2] or "", r[3] or "")):
        groups[c].append((role or "", text or ""))
    rows = {r.conv_id: r for r in chat.digest(formatted).collect()}
    assert rows.keys() == groups.keys()
    for c, turns_ in groups.items():
        loss = "".join(t for r, t in turns_ if r == "assistant")
        said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns_).encode()).hexdigest()
        assert (rows[c].n_turns, rows[c].turns_sha256, rows[c].loss_chars, rows[c].loss_sha256) == (len(turns_), said, len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    for r in formatted.collect():
        assert len(r.input_ids) == len(r.loss_mask) == len(r.token_starts) and chat.parse(r.formatted) == groups[r.conv_id]
    assert chat.digest(chat.format_chats(turns.limit(0), chat.tokenizer_path())).count() == 0


def test_chats_of_many_megabytes(spark):
    """More than a task holds at once, and one conversation that is longer than that."""
    rng = random.Random(16)
    say = lambda n: " ".join(rng.choice(("alpha", "beta", "[INST]", "<|endoftext|>", "日本", "x\n\n")) for _ in range(n))
    rows = [(c, n, ("user", "assistant")[n % 2], say(200_000 if c == 7 else 3000)) for c in range(40) for n in range(4)]
    found = {r.conv_id: r for r in chat.digest(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), chat.tokenizer_path())).collect()}
    assert len(found) == 40
    for c in range(40):
        loss = "".join(t for i, _, role, t in rows if i == c and role == "assistant")
        assert found[c].n_turns == 4 and found[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_escaping():
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(("<|", "\\", "<", "|", "s>", "/s>", "[INST]", "[/", "INST]", "a", chat.MARK, "<<SYS>>", "<s>")) for _ in range(rng.randint(0, 12)))
        out = chat.escape(text)
        assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROLS)


def test_windows_of_items_whose_id_is_no_number(spark):
    """They hit, but there is no item to name; so it is in one block and in many, and documents of the pipeline that have them go."""
    words = " ".join(f"word{k}" for k in range(12))
    items = spark.createDataFrame([("one", words), ("7", "some other words"), (None, "null id words")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"before {words} after"), (2, "some other words"), (3, "null id words"), (4, "clean")], "doc_id long, text string")
    for block_bytes in (1 << 20, 10):
        got = {r.id: (len(r.hit_words), r.items) for r in decontaminate.contamination(docs, items, block_bytes=block_bytes).collect()}
        assert got == {1: (12, []), 2: (3, [7]), 3: (3, []), 4: (0, [])}
        assert [r.doc_id for r in decontaminate.clean_rows(docs, items, block_bytes=block_bytes).collect()] == [4]
