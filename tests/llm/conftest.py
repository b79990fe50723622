from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and one id with two texts."""
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(5003)}" for _ in range(60_000))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (None, "some words of a row without an id", "en", None, 33),
        (4, long, "en", "a", len(long)), (5, "the same text twice here", None, "b", 24), (5, "the same text twice here", None, "b", 24),
        (5, "another text under the same id", None, "b", 30), (None, None, None, None, None), (6, "one", "fr", "b", 3),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
