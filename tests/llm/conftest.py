import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and white texts, repeats, ties, a long text, columns whose names operators use inside."""
    words = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", "  \t\n", "a", "a", "A b c", words, "x " + words, words, "é" * 3000 + " 漢字 " + "z" * 5000, "1234 !!", words + " tail one two", "a", "<|endoftext|> it's"]
    rows = [(i * 3, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 3}", 0) for i, t in enumerate(texts)]
    rows += [rows[6], rows[3], (None, "a", "en", "s1", 0), (None, None, None, None, None)]
    return spark.createDataFrame([Row(*r) for r in rows], SCHEMA).selectExpr("*", "1 AS size", "'q' AS target", "2 AS row", "3 AS h", "4 AS block", "5 AS fp", "6 AS n", "7 AS score", "8 AS at", "'i' AS id", "'j' AS _id", "'k' AS sha", "'l' AS _sha", "'m' AS _said", "'n' AS said", "9 AS mark", "10 AS _row")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
