from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ka ro mi ten sul ve da lor pim ash".split() for b in "ra ti lo men su vi dor el ang po".split()]


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(WORDS) + rng.choice(("", "", "", rng.choice(WORDS))) for _ in range(n)]
    return " ".join(w + rng.choice(("", "", "", ".", ",")) for w in words)


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
    return " ".join(words)


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and clashing extra columns."""
    rng = random.Random(5)
    base = prose(rng, 300)
    rows = [
        (1, base, "en", "a", 5),
        (2, base, "en", "a", 5),
        (2, base, "en", "a", 5),
        (3, edited(rng, base, 2), "en", "b", None),
        (4, None, None, None, None),
        (5, "", "en", "a", 0),
        (6, " \n\t ", "en", None, 4),
        (7, "One two", "en", "b", 7),
        (8, "one TWO", None, "b", 7),
        (None, base, "en", "a", 5),
        (None, prose(rng, 80), None, "c", 9),
        (9, prose(rng, 30_000), "en", "c", 1),
        (10, "ab " * 4000, "en", "c", 1),
        (11, "x" * 3000, "fr", "é", 1),
        (12, "### $$$ \x0b&&& \x0c***", "de", "é", 1),
        (13, "né à Ñandú 日本語 \U0001f600 <|endoftext|> it's  two  spaces\r\n", "es", "", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    for name in ("score", "kept", "size", "bucket", "component_id", "h", "key", "_id", "toxic", "segment", "start", "row"):
        docs = docs.withColumn(name, F.lit("extra"))
    return docs


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
