import random

import pytest
from pyspark.sql import functions as F

WORDS = "the of and river stone light water house garden window paper silver morning evening quiet ancient letter bridge forest market".split()


@pytest.fixture(scope="session")
def prose():
    """A maker of random texts of n words."""

    def make(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with names that operators use inside."""
    long = prose(30_000, 1)
    rows = [
        (1, "Some words here, and an end.", "en", "a", 28),
        (1, "Some words here, and an end.", "en", "a", 28),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (None, prose(80, 2), "fr", "b", 5),
        (4, " \t\n ", "fr", "b", 4),
        (5, long, "en", None, len(long)),
        (6, prose(80, 3) + " é ß 日本 \U0001f600 <|endoftext|>", None, "b", 1),
        (7, "12345 !!! ###", "en", "a", 13),
        (8, "before\0after " + prose(70, 4), "en", "a", 9),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit("x") for c in ("size", "key", "part", "p", "target", "held_out", "score", "words", "length", "piece", "sha", "keep", "rule", "list", "level", "n", "q_kept", "q_words", "j_row", "j_n", "m_row", "m_copy", "l_pred", "judged", "row", "times")}
    return table.withColumns(clash)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, None, 0), (5, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
