import pytest

#: Rows that every document operator must take: nulls, empty and blank texts, repeated rows, one very long text.
EDGE_ROWS = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, "a", 4),
    (4, "one two three", "en", None, 13),
    (5, "The quick brown fox jumps over the lazy dog again and again", "en", "b", None),
    (5, "The quick brown fox jumps over the lazy dog again and again", "en", "b", None),
    (6, "the Quick brown fox jumps over the lazy dog again and again", "en", "b", None),
    (None, "a row without an id has words as well", "en", "b", None),
    (7, " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000)), "en", "c", None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def edge_docs(spark):
    """Edge rows with extra columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE_ROWS, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("id", "key", "a", "b", "n", "ids", "score", "word", "count", "rep")})


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
