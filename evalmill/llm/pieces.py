"""SentencePiece encoding and decoding with spans in the original bytes.

The model file is read here: pieces with scores, and the normaliser with its compiled character map (a
double-array trie over UTF-8 and a table of replacements). Normalising walks the text: at each place the
longest prefix in the map is replaced, else one character is copied, and each normalised character records
the original bytes that it came from. Pairs are merged by score inside runs that no piece can cross (spaces
and what follows them, up to the next space or between two characters that stand side by side in no piece,
like a letter and a comma), which are cached. Each piece covers a run of normalised
characters and so a span of original bytes; the byte pieces of one character all have its span. Decoding is
that of the sentencepiece library.

Edge cases. Null text is empty: its ids are those of begin and end. Bytes that are not UTF-8 become U+FFFD.
Repeated rows give equal rows; an empty table gives none; other columns are never read.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import repeat
from math import inf
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_batches, texts_of

SPACE = "▁"
#: Cached runs of a worker; it starts anew beyond.
CACHE_RUNS = 500_000
#: Texts that are encoded before their results are passed on.
TEXTS = 100
#: Characters up to which a run's pairs are looked through for each merge; longer ones have a heap.
SHORT_RUN = 48

PIECE = np.dtype([("id", "<u4"), ("size", "<u2")])
ENCODED = "id bigint, ids binary, spans binary, decoded string"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 5:
            yield tag >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        elif kind == 1:
            yield tag >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {kind}")


class CharMap:
    """The compiled character map: longest prefix, and what it becomes."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes read at this place, and their replacement; None if no prefix is in the map."""
        units, node, best = self.units, 0, None
        if not units:
            return None
        node ^= self._offset(units[0])
        for n in range(at, len(text)):
            node ^= text[n]
            if node >= len(units) or units[node] & 0x800000FF != text[n]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = (n + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.strings[best[1] : self.strings.index(b"\0", best[1])]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


class Normalizer:
    """Normalised text and, for each of its characters, the first and last byte (exclusive) of its source."""

    def __init__(self, blob: bytes = b"", dummy_prefix: bool = True, strip: bool = True, escape: bool = True):
        self.map, self.dummy_prefix, self.strip = CharMap(blob), dummy_prefix, strip
        self.space = SPACE if escape else " "

    def __call__(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        if not self.map.units and not self.strip:
            return self._plain(text)
        raw = text.encode("utf-8", "surrogatepass")
        chars, first, last, at = [], [], [], 0
        while at < len(raw):
            hit = self.map.longest(raw, at)
            if hit is None:
                n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                hit = n, raw[at : at + n]
            n, new = hit
            for c in new.decode("utf-8", "replace"):
                if not (self.strip and c == " " and (not chars or chars[-1] == " ")):
                    chars.append(c)
                    first.append(at)
                    last.append(at + n)
            at += n
        if self.strip and chars and chars[-1] == " ":
            for x in (chars, first, last):
                x.pop()
        if chars and self.dummy_prefix:
            chars.insert(0, " ")
            first.insert(0, first[0])
            last.insert(0, first[0])
        return "".join(chars).replace(" ", self.space), np.array(first, np.int64), np.array(last, np.int64)

    def _plain(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """An empty map keeps every character: the same result without a walk."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        last = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
        first = np.concatenate((np.zeros(min(1, len(last)), np.int64), last[:-1]))
        if text and self.dummy_prefix:
            text, first, last = " " + text, np.concatenate(([0], first)), np.concatenate(([0], last))
        return text.replace(" ", self.space), first, last


def _runs(pieces: Iterable[str]) -> re.Pattern:
    """Runs that no piece can cross. Characters that stand side by side in some piece are of one class, with all that these are linked to; a run is spaces and characters of one class,
    or spaces and one character that no piece has beside another. Merges only make pieces, so none joins two runs."""
    group: dict[str, set[str]] = {}
    for piece in pieces:
        for x, y in zip(piece, piece[1:]):
            if SPACE in (x, y):
                continue
            a, b = group.setdefault(x, {x}), group.setdefault(y, {y})
            if a is not b:
                a, b = (a, b) if len(a) >= len(b) else (b, a)
                a |= b
                group.update(dict.fromkeys(b, a))
    classes = sorted({id(g): "".join(sorted(g)) for g in group.values()}.values(), key=lambda g: (-len(g), g))
    return re.compile(f"{SPACE}*(?:{''.join(f'[{re.escape(g)}]+|' for g in classes)}[^{SPACE}])|{SPACE}+")


class Pieces:
    """A BPE model file with byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte: dict[int, int] = {}
        self.unk, self.bos, self.eos = 0, -1, -1
        normal = {}
        n = 0
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                text, kind = piece[1].decode(), piece.get(3, 1)
                if kind == 1:
                    self.ids[text], self.score[text] = n, piece.get(2, 0.0)
                elif kind == 2:
                    self.unk = n
                elif kind == 6:
                    self.byte[int(text[3:-1], 16)] = n
                elif kind == 3:
                    self.bos, self.eos = n if text == "<s>" else self.bos, n if text == "</s>" else self.eos
                else:
                    raise ValueError("user-defined and unused pieces are not handled")
                n += 1
            elif field == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("not a BPE model")
            elif field == 3:
                normal = dict(_fields(value))
        self.normalizer = Normalizer(normal.get(2, b""), bool(normal.get(3, 1)), bool(normal.get(4, 1)), bool(normal.get(5, 1)))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space inside; runs between spaces would not be independent")
        self.runs = _runs(self.ids)
        self.packed = {p: struct.pack("<IH", n, len(p) << 1) for p, n in self.ids.items()}
        self.cache: dict[str, bytes] = {}

    def _merge(self, run: str) -> list[str]:
        """The pieces of a run: the pair with the best score, leftmost of equals, is merged until none is left."""
        score, parts = self.score.get, list(run)
        if len(parts) <= SHORT_RUN:
            pairs = list(map(score, map(add, parts, parts[1:]), repeat(-inf)))
            while pairs and (best := max(pairs)) > -inf:
                i = pairs.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = score(parts[i] + parts[i + 1], -inf)
                if i:
                    pairs[i - 1] = score(parts[i - 1] + parts[i], -inf)
            return parts
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (s := score(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, len(parts[i]), len(parts[j])))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, n, m = heapq.heappop(heap)
            if len(parts[i]) != n or len(parts[j]) != m or after[i] != j:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def _run(self, run: str) -> bytes:
        """Packed as PIECE: ids, and of each the characters of the run, times two; or 1 for a byte piece before its character's last."""
        parts = self._merge(run)
        try:
            found = b"".join([self.packed[p] for p in parts])
        except KeyError:
            found = self._with_bytes(parts)
        if len(self.cache) >= CACHE_RUNS:
            self.cache.clear()
        if len(run) < 100:
            self.cache[run] = found
        return found

    def _with_bytes(self, parts: list[str]) -> bytes:
        """The same where some parts are no pieces."""
        found = []
        for p in parts:
            if p in self.packed:
                found.append(self.packed[p])
            elif self.byte:
                raw = p.encode("utf-8", "surrogatepass")
                found += [struct.pack("<IH", self.byte[b], len(p) << 1 if k == len(raw) - 1 else 1) for k, b in enumerate(raw)]
            else:
                found.append(struct.pack("<IH", self.unk, len(p) << 1))
        return b"".join(found)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids with begin and end, and a row for each with the first and last byte (exclusive) of its source."""
        normal, first, last = self.normalizer(text)
        get, run = self.cache.get, self._run
        found = np.frombuffer(b"".join([get(x) or run(x) for x in self.runs.findall(normal)]), PIECE)
        ids, sizes = found["id"], found["size"].astype(np.uint32)
        n, end = len(text.encode("utf-8", "surrogatepass")), np.cumsum(sizes >> 1)
        spans = np.zeros((len(ids) + 2, 2), np.uint32)
        if len(ids):
            start = end - (sizes >> 1)
            part = sizes == 1
            spans[1:-1, 0] = first[start]
            spans[1:-1, 1] = last[np.where(part, start, end - 1)]
        spans[-1] = n
        return np.concatenate(([self.bos], ids, [self.eos])).astype("<u4"), spans


def _model(path: str) -> Pieces:
    """One for all tasks of a worker that encode, until the worker runs something else."""
    own = kept(__name__)
    if path not in own:
        own[path] = Pieces(path)
    return own[path]


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id; ids as little-endian unsigned 32-bit integers; spans, two such integers for each id; decoded text."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        model, library = _model(model_path), SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                out = [model.encode(t.decode("utf-8", "replace")) for t in texts_of(part["text"])]
                decoded = library.decode([ids.tolist() for ids, _ in out], num_threads=1)
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array([ids.tobytes() for ids, _ in out], pa.binary()), pa.array([s.astype("<u4").tobytes() for _, s in out], pa.binary()), pa.array(decoded, pa.string())],
                    ["id", "ids", "spans", "decoded"],
                )

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), f, ENCODED)


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return rows.select(F.col("id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digest(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path()))
