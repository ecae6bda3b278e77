import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, id string, n int, region int"
LONG = "word " * 60_000 + "end"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, "the cat sat on the mat and the dog ran off", "en", "a", 42, "x", "y", "z", 1, 2),
        (1, "the cat sat on the mat and the dog ran off", "en", "a", 42, "x", "y", "z", 1, 2),
        (2, None, "en", "a", None, None, None, None, None, None),
        (3, "", "de", None, 0, None, None, None, None, None),
        (None, "the cat sat on the mat and the dog ran off", None, "b", 42, None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None, None),
        (4, LONG, "en", "b", len(LONG), None, None, None, None, None),
        (5, "  \n\t \x0b\n", "fr", "b", 7, None, None, None, None, None),
        (6, "1234 5678 !!! ###", "fr", "c", 17, None, None, None, None, None),
        (7, "été à la plage \U0001f600 über straße", "fr", "c", 30, None, None, None, None, None),
        (8, "the cat sat on the mat and the dog ran off", "en", "a", 42, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
