import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, long and repeated texts, ties, repeated rows, and further columns with clashing names."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
    rows = [
        (1, "plain words in a plain line\nplain words in a plain line", "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (4, long, "en", "a", 5),
        (5, long, "de", None, 5),
        (5, long, "de", None, 5),
        (6, " \t\n", "en", "", 3),
        (7, "naïve Ünïcode 漢字 \U0001f600 text ſ K token=abcdef123 x", "fr", "b", 9),
        (None, "no id here, but words enough to count", "en", "a", 2),
        (8, "x", None, "c", 1),
    ]
    frame = spark.createDataFrame(rows, COLUMNS)
    names = ["size", "start", "pos", "shard", "_hash", "_block", "ids", "words", "file", "value", "score", "count", "old", "cut", "row", "blob", "spans", "n", "key", "sid", "doc", "runs", "times", "nth", "text_hash", "block", "taken"]
    return frame.select("*", *(F.lit("clash").alias(n) for n in names)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
