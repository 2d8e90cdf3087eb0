import pytest

FIELDS = "text string, doc_id long, lang string, source string, n_chars long, extra int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every kind of odd value: nulls, empty and long texts, ties, repeats, more columns."""
    long = "word another thing " * 20_000
    rows = [
        ("", 1, "en", "a", 0, 1),
        (None, 2, None, None, None, None),
        ("  \n\t ", 3, "de", "a", 5, 1),
        ("1234 --- 5678", 4, "en", "a", 13, 1),
        ("the cat sat on the mat", 5, "en", "a", 22, 1),
        ("the cat sat on the mat", 6, "en", "b", 22, 2),
        ("the cat sat on the mat", 6, "en", "b", 22, 2),
        ("The Cat SAT on the mat", 7, "en", "b", 22, 2),
        (long, 8, "en", None, len(long), 3),
        ("x" * 50_000, 9, "fr", "c", 50_000, 3),
        ("mail a.b@c.example.com or +1 (234) 555-1234 now", 10, "en", "c", 40, 3),
        ("日本語 テキスト ▁ <|endoftext|> <s> \x00 é", 11, "ja", "c", 30, 3),
        (None, None, None, None, None, None),
        ("le chat est sur le tapis", None, "fr", "c", 24, 1),
    ]
    return spark.createDataFrame(rows, FIELDS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], FIELDS)
