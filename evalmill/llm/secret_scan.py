"""Secret scans: candidates by public formats, false positives removed by a random forest.

Candidates are values assigned to names such as token or password, strings of well-known key formats, and
long runs of base64 or hexadecimal characters; of a PEM key the whole block. A candidate's features are its length, entropy, shares and
transitions of character classes, how much of it dictionary words cover, what its path looks like, and words
beside it. The forest (Spark ML) is trained from labelled findings; a candidate stays if its probability is `least` or
more.

The dictionary is learned from the words beside all candidates of the corpus: all that several findings have beside them. It is a
table: what a value's runs of letters contain is joined with it, so no task and no driver holds it. Whole texts are scanned, and values are
taken whole, however long; the text itself never leaves the map task, only its candidates do.

Edge cases. Null and empty texts have no candidate. Rows with a null id or path are scanned like others. Repeated rows give
their findings once each. An empty table gives no rows. Other columns are never read.
"""

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, staged

BESIDE, LEAST = 60, 0.5

#: Public formats of keys, names of secrets, and words that mark a placeholder or a test.
NAMES = "key|token|secret|passw(?:or)?d|pwd|credential"
FORMATS = {
    "aws": r"AKIA[0-9A-Z]{16}",
    "github": r"gh[pousr]_[A-Za-z0-9]{36}",
    "slack": r"xox[abpr]-[A-Za-z0-9-]{10,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
    "pem": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[^-]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?",
    "assigned": rf"(?i:{NAMES})[\w.-]{{0,20}}[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?(?P<value>[^\s\"',;]{{8,}})",
    "run": r"[A-Za-z0-9+/_=-]{32,}",
}
#: What every candidate but a run has in it, in lower case.
CORES = ("key", "token", "secret", "passw", "pwd", "credential", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "eyj")
#: Letters that matching without case takes for s, i and k, but str.lower() doesn't (or not for these alone).
ODD_CASES = ("\u017f", "\u0130", "\u0131", "\u212a")
PLACEHOLDER = ("example", "sample", "dummy", "placeholder", "changeme", "your", "test", "todo", "none", "null", "fake", "xxx")
MARKS_PATH = ("test", "example", "doc", "mock", "fixture", "sample", "spec", "lock")
HINTS = ("key", "token", "secret", "password", "pwd", "credential", "auth", "private", "api", "bearer")
DOUBTS = ("commit", "hash", "sha", "checksum", "digest", "uuid", "id", "integrity", "revision", "md5")

CANDIDATE = re.compile("|".join(f"(?P<{k}>{v})" for k, v in FORMATS.items()))
WORD = re.compile(r"[^\W\d_]{3,}")
PARTS = "v string, w string"
FOUND = "id bigint, path string, start bigint, end bigint, kind string, value string, before string, after string"


def _run_table() -> bytes:
    return bytes(97 if b < 128 and (chr(b).isalnum() or chr(b) in "+/_=-") else 32 for b in range(256))


RUN_TABLE, RUN = _run_table(), b"a" * 32


def may_have(text: str) -> bool:
    """Is there any candidate? Never false where CANDIDATE matches: most texts need no search by the pattern, which is slow."""
    low = text.lower()
    return any(c in low for c in CORES) or RUN in text.encode("utf-8", "surrogatepass").translate(RUN_TABLE) or any(c in text for c in ODD_CASES)


def candidates_of(text: str) -> Iterator[tuple[int, int, str, str]]:
    """First and last character (exclusive), kind and value of each candidate."""
    if not may_have(text):
        return
    for m in CANDIDATE.finditer(text):
        inner = m.lastgroup == "value" or m["value"] is not None
        kind = next(k for k in FORMATS if m[k] is not None)
        start, end = m.span("value") if inner else m.span()
        yield start, end, kind, text[start:end]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, path, text in zip(batch["id"].to_pylist(), batch["path"].to_pylist(), batch["text"].to_pylist()):
            for start, end, kind, value in candidates_of(text or ""):
                rows.append((i, path, start, end, kind, value, text[max(0, start - BESIDE) : start], text[end : end + BESIDE]))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in FOUND.split(", ")])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), path.alias("path"), F.col(text_col).cast("string").alias("text")), _find, FOUND)


def dictionary(found: DataFrame) -> DataFrame:
    """w: the words that at least three candidates have beside them."""
    beside = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "before", "after")), F.lit(r"(\p{L}{3,})"), F.lit(1)))
    return found.select(F.explode(beside).alias("w")).groupBy("w").count().where("count >= 3").select("w")


def _parts(most: int):
    """What may be a word of 3 to most letters within each value, with the value's hash."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch["value"].to_pylist():
                v = hashlib.sha256(value.encode()).hexdigest()
                for run in WORD.findall(value.lower()):
                    for b in range(0, len(run), 1000):
                        own = sorted({run[i : i + n] for i in range(b, min(b + 1000, len(run))) for n in range(3, min(most, len(run) - i) + 1)})
                        yield pa.RecordBatch.from_arrays([pa.array([v] * len(own), pa.string()), pa.array(own, pa.string())], ["v", "w"])

    return f


def _words_in(rows: DataFrame, words: DataFrame) -> DataFrame:
    """v, w: the dictionary words that stand in each distinct value of the rows, by its SHA-256."""
    most = words.agg(F.max(F.length("w"))).first()[0] or 0
    return map_batches(rows.select("value").where("value is not null").distinct(), _parts(most), PARTS).join(words, "w", "left_semi")


@lru_cache(8)
def _sizes(words: frozenset[str]) -> list[int]:
    return sorted({len(w) for w in words})


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(value: str, path: str | None, before: str, after: str, words: frozenset[str]) -> list[float]:
    n, counts = max(len(value), 1), Counter(value)
    classes = [_class(c) for c in value]
    low, near, where = value.lower(), [w.lower() for w in WORD.findall(before)[-6:] + WORD.findall(after)[:3]], (path or "").lower()
    covered = [False] * len(low)
    for size in _sizes(words):
        for i in range(len(low) - size + 1):
            if low[i : i + size] in words:
                covered[i : i + size] = [True] * size
    has = lambda marks, texts: float(any(m in t for m in marks for t in texts))
    return [
        float(len(value)),
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        len(counts) / n,
        *(classes.count(k) / n for k in range(4)),
        sum(a != b for a, b in zip(classes, classes[1:])) / n,
        sum(a == b for a, b in zip(value, value[1:])) / n,
        sum(ord(b) - ord(a) == 1 for a, b in zip(value, value[1:])) / n,
        float(all(c in "0123456789abcdef-" for c in low)),
        sum(covered) / max(len(low), 1),
        has(PLACEHOLDER, [low]),
        has(MARKS_PATH, [where]),
        has(HINTS, near),
        has(DOUBTS, near),
        has(PLACEHOLDER, near),
    ]


def _featured(found: DataFrame, words: frozenset[str] | DataFrame) -> DataFrame:
    """words: those of a small dictionary, or a table with the column w."""
    if isinstance(words, DataFrame):
        own = _words_in(found, words).groupBy(F.col("v").alias("__v")).agg(F.collect_set("w").alias("__words"))
        f = F.pandas_udf(lambda *columns: pd.Series([features(*x[:4], frozenset(() if x[4] is None else x[4])) for x in zip(*columns)], dtype=object), "array<double>")
        rows = found.join(own, F.sha2("value", 256) == F.col("__v"), "left").drop("__v")
        return rows.withColumn("features", array_to_vector(f("value", "path", "before", "after", "__words"))).drop("__words")
    shared = found.sparkSession.sparkContext.broadcast(words)

    def f(value: pd.Series, path: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([features(*x, shared.value) for x in zip(value, path, before, after)], dtype=object)

    f = F.pandas_udf(f, "array<double>")
    return found.withColumn("features", array_to_vector(f("value", "path", "before", "after")))


def labelled_findings(spark: SparkSession, n: int = 3000, seed: int = 7) -> DataFrame:
    """Findings made by rule, half of them secrets: value, path, before, after, label."""
    rng = random.Random(seed)
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    syllables = ("the", "and", "ing", "ion", "her", "ver", "con", "ent", "que", "del", "der", "ich", "une", "para", "ment", "tion", "data", "file", "user", "name", "path", "line")
    speak = lambda a, b, by="": by.join(rng.choice(syllables) for _ in range(rng.randint(a, b)))
    rows = []
    for k in range(n):
        beside = " ".join(speak(1, 3) for _ in range(8))
        plain_path, odd_path = f"src{rng.randint(0, 99)}", rng.choice(("tests/", "docs/", "examples/", "mock/")) + speak(1, 2)
        if k % 2:
            value = rng.choice((lambda: pick(hexa, 32, 64), lambda: pick(b64, 24, 60), lambda: "AKIA" + pick(b64[:26], 16, 16), lambda: "ghp_" + pick(b64[:62], 36, 36), lambda: pick(b64[:62] + "!#$%&*", 10, 24)))()
            name = rng.choice(("token = \"", "api_key: ", "password = '", "secret=", "auth_token: ", "private key "))
            rows.append((value, plain_path if rng.random() < 0.9 else odd_path, f"{beside} {name}", beside, 1.0))
        else:
            value = rng.choice((lambda: rng.choice(("your-", "example_", "test", "dummy-", "changeme")) + speak(1, 3, "_"), lambda: speak(4, 12, rng.choice(("", "-", "_", "/"))), lambda: rng.choice("x*0-=_a") * rng.randint(8, 60), lambda: "0123456789abcdefghijklmnopqrstuvwxyz"[: rng.randint(10, 36)], lambda: pick(hexa, 40, 40), lambda: pick(hexa, 8, 8) + "-" + "-".join(pick(hexa, 4, 4) for _ in range(3)) + "-" + pick(hexa, 12, 12)))()
            if rng.random() < 0.25:  # as random as a secret, but known by its neighbours
                value = rng.choice((lambda: "sha512-" + pick(b64, 86, 86) + "==", lambda: pick(b64, 43, 43) + "=", lambda: pick(hexa, 32, 32), lambda: pick(hexa, 64, 64)))()
                rows.append((value, odd_path if rng.random() < 0.3 else plain_path, f"{beside} {rng.choice(('integrity ', 'checksum: ', 'md5 ', 'digest=', 'commit ', 'revision ', 'hash: '))}", beside, 0.0))
                continue
            sha = len(value) >= 36 and set(value) <= set(hexa + "-")
            name = rng.choice(("commit ", "sha256: ", "checksum=", "uuid ", "revision ")) if sha else rng.choice(("token = \"", "password: ", "path ", "key=", "see "))
            rows.append((value, odd_path if rng.random() < 0.5 else plain_path, f"{beside} {name}", beside, 0.0))
    return spark.createDataFrame(rows, "value string, path string, before string, after string, label double")


def train(labelled: DataFrame, words: frozenset[str], trees: int = 40, depth: int = 8, seed: int = 1) -> RandomForestClassificationModel:
    """labelled: value, path, before, after, label. The model comes without its training summary, which holds the session and so can't travel to tasks."""
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(_featured(labelled, words).select("features", "label")).copy()


def scan(docs: DataFrame, labelled: DataFrame, least: float = LEAST, **columns: str | None) -> DataFrame:
    """One row per candidate: id, start, end (characters), kind, value, probability, kept."""
    found = staged(candidates(docs, **columns), "candidates")
    words = staged(dictionary(found), "dictionary")
    known = frozenset(r.w for r in _words_in(labelled, words).select("w").distinct().collect())  # as many as the labelled values contain
    rows = train(labelled, known).transform(_featured(found, words))
    p = vector_to_array("probability")[1]
    return rows.select("id", "start", "end", "kind", "value", p.alias("probability"), (p >= least).alias("kept"))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), labelled_findings(spark))
    return found.select(F.col("id").alias("doc_id"), "start", "end", "kind", F.sha2("value", 256).alias("value_sha256"), "probability", "kept")
