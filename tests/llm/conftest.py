"""A small table of documents with every oddity at once, and plain helpers."""

import random
import re

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("block", T.StringType()), T.StructField("key", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("n", T.StringType()), T.StructField("rest", T.StringType()), T.StructField("spans", T.StringType()),
    T.StructField("length", T.StringType()), T.StructField("kept", T.StringType()),
])


def odd_rows() -> list[tuple]:
    random.seed(7)
    words = [f"{a}{b}{c}" for a in "abcdeé" for b in "aeiou" for c in "nrstß"]
    some = lambda k: " ".join(random.choices(words, k=k))
    passage = some(40)
    texts = [some(random.randint(1, 120)) for _ in range(40)]
    texts += [t.replace(" ", "  ", 2).upper() for t in texts[:6]]  # equal words, other bytes
    for t in texts[6:16]:
        w = t.split()
        w[random.randrange(len(w))] = "changed"
        texts.append(" ".join(w))  # near copies
    texts += [f"{some(20)} {passage} {some(15)}" for _ in range(8)] + [passage] * 3 + texts[:5]
    texts += [None, "", " \n\t", "x", "one two three", "one two three", "ONE two  three", "same " * 70, "▁ ▁▁a", "tab\tand\x0bmore\x1fhere"]
    texts += ["long " + some(30_000), some(100) + "\n" + some(100) + "\n" + some(3)]
    texts += ["write me.now@mail.example.org or a@b.c@d.e, +1 (555) 010-2030; 10.0.0.300 10.1.2.3.4.5.6.7 4111 1111-1111 1111 4111111111111112"]
    rows = [(1000 + 3 * k - 700 * (k % 2), t) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (rows[5][0], "another text under an id that is taken " + some(20)), (None, texts[2]), (None, some(60)), (None, None)]
    rows += [(-5, texts[9])]
    langs = ["en", "de", None]
    return [(i, t, langs[k % 3], "b", "k", "s", "n", "r", "p", "l", "t") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd():
    return [(r[0], r[1] or "") for r in odd_rows()]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text)
