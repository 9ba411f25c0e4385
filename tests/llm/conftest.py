import pytest

SMALL = "/root/testdata/sf0.001"
LONG = "word " * 3000 + "x" * 5000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls anywhere, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [
        (1, "", "en", "a"),
        (2, None, "en", "a"),
        (3, "the cat sat on the mat today", "en", "a"),
        (3, "the cat sat on the mat today", "en", "a"),
        (4, "The Cat sat\ton the\nmat today", None, None),
        (5, LONG, "en", "b"),
        (None, "the cat sat on the mat today", "fr", "b"),
        (None, None, None, None),
        (6, "12 34 !!", "fr", "b"),
        (7, "a b", "fr", "b"),
        (8, "　  \x1c <|endoftext|> café▁don't \U0001f600", "fr", None),
    ]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    names = ("score", "part", "n", "cls", "copy", "rate", "lang_pred", "spans", "piece_ids", "shuffle_key", "rank")
    return df.withColumns({x: F.lit(1) for x in names}).cache()


@pytest.fixture(scope="session")
def none(odd):
    """The same columns without rows."""
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r for r in documents.collect()}
