"""Chat formatting with loss masks aligned by offsets.

Template: MARK role MARK text for each turn, and MARK at the end, where MARK is a special token of the
tokenizer, so no token lies across the border of a text. A control string inside a role or text gets a
backslash after its first character (one more, if it has some already), which unescape() takes away.

A whole conversation is rendered and encoded once, with character offsets. The assistants' text spans are
sorted, and so are the tokens' offsets: two binary searches give each span its run of tokens.

Rows are dealt by conversation and sorted, and tasks read them as a stream; a conversation, being one
training example, is held by one task.

Edge cases. Null text or role is empty; null ids form one conversation; rows that repeat a turn follow each
other by role and text. An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

MARK = "<|endoftext|>"
#: Strings with which public chat templates steer a model.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROLS))
_UNESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROLS))

FORMATTED = "conv_id bigint, formatted string, input_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"
DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    """Reversible; what comes out holds no control string."""
    return _ESCAPE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of the texts to learn, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{MARK}{escape(role)}{MARK}", escape(text)
        at += len(head)
        if role == loss_role:
            spans.append((at, at + len(body)))
        at += len(body)
        parts += (head, body)
    return "".join((*parts, MARK)), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    parts = formatted.split(MARK)[1:-1]
    return [(unescape(r), unescape(t)) for r, t in zip(parts[::2], parts[1::2])]


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """The tokens that overlap a span; starts, ends and spans are sorted."""
    out = np.zeros(len(starts), bool)
    filled = [s for s in spans if s[1] > s[0]]
    if filled:
        a, b = np.array(filled).T
        for i, j in zip(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")):
            out[i:j] = True
    return out


def _format(tokenizer_path: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        if tokenizer.token_to_id(MARK) is None:
            raise ValueError(f"the tokenizer has no {MARK}")

        def finish(convs: list[tuple[int | None, list[tuple[str, str]]]]) -> pa.RecordBatch:
            rows = []
            for conv, turns in convs:
                text, spans = render(turns)
                e = tokenizer.encode(text, add_special_tokens=False)
                offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
                rows.append((conv, text, e.ids, offsets[:, 0], offsets[:, 1], mask(offsets[:, 0], offsets[:, 1], spans)))
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "formatted", "input_ids", "token_starts", "token_ends", "loss_mask"])

        done, size, conv, turns = [], 0, None, []
        for batch in batches:
            for i, role, text in zip(*(batch[c].to_pylist() for c in ("conv", "role", "text"))):
                if turns and i != conv:
                    done.append((conv, turns))
                    turns = []
                    if size > 1 << 20:
                        yield finish(done)
                        done, size = [], 0
                conv = i
                turns.append((role, text))
                size += len(text)
        if turns:
            yield finish([*done, (conv, turns)])

    return f


def format_chats(turns: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, input_ids, token_starts, token_ends (characters), loss_mask."""
    empty = F.lit("")
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), empty).alias("role"), F.coalesce(F.col(text_col).cast("string"), empty).alias("text"))
    return map_batches(rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text"), _format(tokenizer_path), FORMATTED)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k, (conv, text) in enumerate(zip(batch["conv_id"].to_pylist(), batch["formatted"].to_pylist())):
            turns = parse(text)
            on = batch["loss_mask"][k].values.to_numpy(zero_copy_only=False)
            starts, ends = (batch[c][k].values.to_numpy() for c in ("token_starts", "token_ends"))
            learned, a = [], None
            for i in np.flatnonzero(on).tolist():
                if a is None or i != b + 1:  # a new run of tokens
                    if a is not None:
                        learned.append(text[a : ends[b]])
                    a = starts[i]
                b = i
            if a is not None:
                learned.append(text[a : ends[b]])
            loss = "".join(map(unescape, learned))
            said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
            rows.append((conv, len(turns), said.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in DIGEST.split(", ")])


def digest(formatted: DataFrame) -> DataFrame:
    return map_batches(formatted, _read_back, DIGEST)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The conversation that the query adds: control strings of another template in both texts.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat(spark, sf_dir: str) -> DataFrame:
    columns = ("conv_id", "turn", "role", "text")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*columns)
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return digest(format_chats(turns.unionByName(probe), tokenizer_path()))


OP2_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(n, r)),
e AS (SELECT *, length(role) + length(text) + 26 + len(regexp_extract_all(text, '<\\*\||<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>')) AS chars FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, sum(chars) + 13 AS chars FROM e GROUP BY 1)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
