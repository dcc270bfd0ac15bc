import pytest

LONG = " ".join(f"word{i % 977} part{i % 31}" for i in range(20_000))
P1 = "the quick brown fox jumps over the lazy dog near the river bank today"
P2 = "an entirely different passage of text with many other words in it for testing"

#: Nulls in every column, empty and very long texts, ties, repeated rows and columns whose names clash with inner ones.
ROWS = [
    (0, P1, "en", 1),
    (1, P1, "en", 2),
    (2, P1 + " indeed", "en", 3),
    (3, P2 + "\n" + P1, "en", 4),
    (4, "", "en", 5),
    (5, None, "fr", 6),
    (6, " \n\t ", None, 7),
    (7, LONG, "en", 8),
    (8, "short one", "de", 9),
    (8, "short one", "de", 9),
    (None, P1, "en", 10),
    (None, None, None, None),
    (9, "SHORT\tone", "de", 11),
    (10, "été 日本語 " * 5, None, None),
]
SCHEMA = "doc_id long, text string, lang string, node long"


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("doc", "low", "line", "item", "block", "score", "n_replaced", "lines", "row", "value", "doc_", "band"):
        df = df.selectExpr("*", f"node AS `{name}`")
    return df.persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
