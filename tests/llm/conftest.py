import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, copy int, fp string, key string, host string"

LONG = "the licence of a very long text, " * 20_000


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators use themselves."""
    rows = [
        (1, "Same text here, twice.", "en", "a", 22, 0, "x", "k", "h"),
        (2, "Same text here, twice.", "en", None, 22, 0, "x", "k", "h"),
        (2, "Same text here, twice.", "en", None, 22, 0, "x", "k", "h"),
        (3, None, None, "a", None, None, None, None, None),
        (4, "", "fr", "b", 0, 1, None, None, None),
        (5, "  \t\n", "fr", "b", 4, 1, None, None, None),
        (6, LONG, "en", "c", len(LONG), 1, None, None, None),
        (None, "no identity", "en", "c", 11, 1, None, None, None),
        (7, "É ñ 日本 😀 \u0000 ▁x", "es", "c", 1, 1, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).coalesce(2)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
