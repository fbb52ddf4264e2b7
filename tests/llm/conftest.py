import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def tables(spark, data):
    """A table of the small data by name."""
    return lambda name: spark.read.parquet(f"{data}/{name}.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 1),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, "!!! ... \n\n ???", "de", None, 5),
        (5, long, "en", "b", 6),
        (None, "a text without any id at all in it", "en", "b", 7),
        (6, "één ßtraße naïve — 中文 字 🙂 é", None, None, 8),
        (7, "x", "en", "c", 9),
        (8, "\x00\x01 odd \r\n bytes\t", "en", "c", 10),
    ]
    return spark.createDataFrame(rows, DOCS).selectExpr(
        "*", "'mine' AS size", "'mine' AS score", "'mine' AS n_words", "'mine' AS class_id", "'mine' AS value", "'mine' AS _place", "'mine' AS _words",
        "'mine' AS copies", "'mine' AS below", "'mine' AS row", "'mine' AS of",
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
