import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    base = " ".join(f"Word{i}" for i in range(60))
    rows = [(1, base, "en", "a"), (2, base + " more", "en", "a"), (3, base, "en", None), (4, None, None, "b"), (5, "", "en", "b"), (6, "   \n", "en", "b"),
            (7, "one two", None, "b"), (None, base, "en", "b"), (7, "one two", None, "b"), (8, "x" * 3000 + " é́ <|endoftext|> it's", "en", "b"),
            (9, "Ein kurzer Satz.", "de", "c"), (10, " ".join(f"w{i % 97}" for i in range(20000)), "en", "a")]
    return spark.createDataFrame([(*r, "k", 0, "t", 1.0) for r in rows],
                                 "doc_id long, text string, lang string, source string, key string, block int, word string, score double")
