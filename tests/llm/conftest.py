import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, h long, row string, digest string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and empty texts, null keys, repeated rows, ties, a very long text, and columns named as the operators' own."""
    long = "lorem ipsum dolor sit amet " * 40_000
    rows = [
        (1, "Hello there, general reader of many small words", "en"),
        (2, None, "en"),
        (3, "", None),
        (4, " \n\t ", "de"),
        (5, long, "en"),
        (1, "Hello there, general reader of many small words", "en"),
        (6, "Hello there, general reader of many small words", "fr"),
        (None, "a text without a key, mail me@example.com", "en"),
        (None, None, None),
        (7, "x" * 30_000, "en"),
        (8, "日本語 🙂 é \u0000 ß", "ja"),
        (9, "1234 5678", "en"),
    ]
    return spark.createDataFrame([(i, t, lang, "s", 0, 7, "k", 1, "r", "d") for i, t, lang in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
