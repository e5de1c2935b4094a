from __future__ import annotations

import random

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text of the smallest table."""
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SMALL}/documents.parquet' order by doc_id").fetchall())


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, and odd characters."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = " ".join(rng.choice(words) for _ in range(60))
    long = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(3000))
    rows = [
        (1, None, "en", "s0"),
        (2, "", "en", "s1"),
        (3, "Solo", None, None),
        (4, "solo", "en", "s0"),
        (5, text, "en", "s1"),
        (6, text.upper(), "en", "s2"),
        (7, text, "en", "s2"),
        (7, text, "en", "s2"),
        (8, text + " and more", None, "s0"),
        (9, long, "en", "s0"),
        (10, "x" * 300_000, "en", "s0"),
        (11, "été 漢字 😀\x00\x1c   tab\there <|endoftext|> don't", "fr", None),
        (12, "   \n\t ", "en", "s0"),
        (None, text, "en", "s0"),
        (None, None, None, None),
    ]
    return [(i, t, lang, s, len(t or ""), "words", 1, True, "x") for i, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, bucket int, kept boolean, __id string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
