import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, odd spaces, and extra columns with names that operators use inside."""
    long = "word pass code " * 3000 + "end"
    rows = [
        (1, "the cat sat on the mat by the door of the old house near the river and then it slept until noon came round", "en", "a", 10),
        (1, "the cat sat on the mat by the door of the old house near the river and then it slept until noon came round", "en", "a", 10),
        (2, None, None, None, None),
        (None, "no id here  two spaces ", "en", None, 3),
        (4, "", "fr", "b", 0),
        (5, "   \n\t ", None, "b", 5),
        (6, long, "en", "b", len(long)),
        (7, "Ünï 😀 código ça va\u0085x \r\n y", "es", "c", 20),
        (8, "the cat sat on the mat by the door of the old house near the river and then it slept until noon came round", "en", "z", 10),
        (9, long, "en", "b", len(long)),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("rid", "key", "part", "offset", "payload", "n_words", "label", "score", "start", "kind", "hash")})


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
