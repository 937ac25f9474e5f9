import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    long_text = " ".join(f"word{i % 997} and idiot {i}" for i in range(20_000))
    text = "the quick brown fox jumps over the lazy dog near the river bank today " * 3
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, None, None, None), (None, text, "en", "b", 5),
            (None, None, None, None, None), (3, None, "en", "c", 0), (4, "", "en", "a", 0), (5, " \n\t ", "en", "a", 4),
            (6, long_text, "en", "b", len(long_text)), (7, "x", "en", "d", 1), (8, "Größe ΑΒΓ 中文 é", "de", "é", 9),
            (9, "mail ann@mail.example.com or +1 (743) 555-3824", "en", "d", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row", "size", "h", "copies", "shards", "fp", "component_id", "score", "_score", "n_entities", "found",
              "target", "order", "lane", "rank", "key", "z", "spans", "words"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1, int(i % 3 == 0)) for i in range(30)] + [(None, None, None), (2, 1, None), (3, 0, 7)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
