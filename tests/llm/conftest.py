from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

# Names that operators might use inside, as columns of the input.
CLASHES = ("row", "gone", "h", "key", "n", "node", "size", "bucket", "block", "body", "words", "score")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    *[T.StructField(name, T.StringType()) for name in CLASHES],
])


@pytest.fixture
def frame(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source)."""
    def build(rows):
        full = []
        for doc_id, text, *more in rows:
            lang, source = more or ("en", "web")
            full.append((doc_id, text, lang, source, None if text is None else len(text), *CLASHES))
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def vocabulary():
    """Made-up words."""
    pick = random.Random(5)
    return ["".join(pick.choices("abcdefghijklmnopqrstuvwxyzäß", k=pick.randint(2, 9))) for _ in range(900)]


@pytest.fixture
def sentence(vocabulary):
    pick = random.Random(11)
    return lambda n: " ".join(pick.choices(vocabulary, k=n))


@pytest.fixture
def odd_rows(sentence):
    """NULLs, empty and blank texts, a repeated row, one very long text and its copy."""
    long = sentence(30_000)
    return [
        (None, None, None, None), (1, "", "en", "web"), (1, "", "en", "web"), (2, " \n\t ", None, "web"),
        (3, long, "de", "book"), (4, long, "de", None), (5, None, "en", "web"), (6, "word", "en", "book"),
        (None, "two words", "en", None), (7, "\x00 \U0001F600é", "en", "web"),
    ]
