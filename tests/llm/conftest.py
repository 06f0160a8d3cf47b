import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, rk string, size string, shard int, items string, keep_id long, score double"


def _words(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta7", "theta")) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="session")
def hard():
    """Rows with all that may come: nulls, empty and long texts, copies, repeated rows, copied passages."""
    rng = random.Random(11)
    base, passage = _words(rng, 150), _words(rng, 70)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "two words"), (None, "no id " + _words(rng, 30)), (None, "no id " + _words(rng, 30))]
    for i in range(10, 60):
        rows.append((i, _words(rng, rng.randint(1, 200))))
    for i in range(60, 80):
        rows.append((i, base))
    for i in range(80, 110):
        w = base.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 9999)}"
        rows.append((i, " ".join(w)))
    for i in range(110, 125):
        rows.append((i, f"{_words(rng, rng.randint(5, 60))} {passage} {_words(rng, rng.randint(0, 60))}"))
    rows += [(125, "x" * 3000), (126, "ab" * 900), (127, "\0" * 500 + "é" * 300), (128, "日本語" * 400), (129, base.upper()), (130, base.replace(" ", "\n"))]
    rows += [(131, _words(rng, 9000)), (60, base), (60, base), (3, "one"), (10, "another text of an id that repeats")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, hard):
    """With extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "src", 0, 7, 7, "rk", "s", 3, "it", 5, 0.5) for i, t in hard], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


def key(x):
    return (x is None, x)
