import pytest
from pyspark.sql import functions as F


@pytest.fixture
def odd(spark):
    """Nulls, an empty text, ties, repeated rows, and columns of clashing names."""
    rows = [(1, "The quick brown fox jumps over the lazy dog.", "en", 5, 0.1), (2, None, None, None, None), (3, "", "en", 0, 0.0), (4, "The quick brown fox jumps over the lazy dog.", "fr", 9, 1.0), (4, "The quick brown fox jumps over the lazy dog.", "fr", 9, 1.0), (None, "no id here", "x", 1, 2.0), (6, "one", "en", 3, 0.2), (7, "   \n\t ", "en", 3, 0.2), (8, "word " * 60_000, "en", 3, 0.2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, shard int, score double").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))


@pytest.fixture
def none(odd):
    return odd.limit(0)
