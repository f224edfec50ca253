import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Null ids and texts, empty and blank texts, repeated rows, ties, a long text, and clashing extra columns.
LONG = "long words " * 30_000 + "x" * 70_000 + " mail joe@example.com card 4111111111111111 token = \"abcdef0123456789abcd\"\n"
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog, again and again.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog, again and again.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog, again and again.", "en", "b"),
    (3, None, "en", "a"),
    (4, "", "fr", None),
    (5, " \t\n\x0b \r\f ", None, "b"),
    (6, "12 34 -- !!", "fr", "c"),
    (7, LONG, "en", "c"),
    (None, "Le renard brun saute par dessus le chien. été \U0001f642 \x00 　", "fr", None),
    (8, "Le chat noir dort. Été comme hiver", "fr", "a"),
]
CLASHING = "ids decoded n n_tokens n_words kept comp key id text size copy block found media payload digest score lang_pred row".split()


@pytest.fixture(scope="session")
def edge(spark):
    """The edge cases; every name that an operator makes is also the name of an extra column."""
    schema = "doc_id long, text string, lang string, source string"
    rows = spark.createDataFrame(EDGE, schema)
    for name in CLASHING:
        if name != "text":
            rows = rows.withColumn(name, rows["doc_id"] * 0 - 7)
    return rows


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
