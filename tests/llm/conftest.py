import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                       # columns whose names the operators use themselves
                       *[T.StructField(c, T.StringType()) for c in ("n_words", "key", "cid", "h", "part", "host", "kept", "start", "spans")]])


def prose(r: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def make_rows() -> list[tuple]:
    """Documents with copies, near copies, shared passages, odd white space, personal data, nulls and one long text."""
    r = random.Random(5)
    base, passage = prose(r, 200), prose(r, 70)
    texts: list = [None, "", " ", "\n\n", "one", "a b c", "A b C", "tail  \n", "é ü 日本語 🎉", "\x01 \x00 x", "▁mark ▁▁", "<|endoftext|> x <s>",
                   "#$% | <x> &&", "same line\nsame line\nsame line\nother", " ".join(["loop again now"] * 30)]
    texts += [" ".join(base)] * 3
    for i in range(6):  # near copies: a few words changed
        copy = list(base)
        for at in r.sample(range(200), i):
            copy[at] = f"new{i}x{at}"
        texts.append(" ".join(copy))
    for i in range(5):  # a passage in otherwise new text, with a few words changed in some
        inner = list(passage)
        if i > 2:
            inner[20], inner[45] = f"p{i}", f"q{i}"
        texts.append(" ".join(prose(r, 80 + 10 * i) + inner + prose(r, 60)))
    texts += [" ".join(prose(r, n)) for n in (18, 19, 20, 60, 300)] + [" ".join(prose(r, 5000, 300))]
    texts += ["mail joe.doe@mail.example.com or 10.20.30.40, 999.1.1.1 and +1 (404) 555-0199 now", "cards 4111 1111 1111 1111 4111111111111111 end",
              "two 4111111111111111 4111111111111111 cards", "a@b", "x@y.z@w.v"]
    rows = [(i, t, "en", f"host{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[16], rows[20], (None, "null id text", "en", "host0", 3)]  # repeated rows and a null id
    return [row + ("x",) * 9 for row in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
