import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, key string, part int, bucket long"
LONG = "lorem ipsum dolor sit amet 0123 " * 8000


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls everywhere, empty, blank and very long texts, repeated rows and columns whose names operators use inside."""
    def row(doc_id, text, lang="en", source="s1"):
        return doc_id, text, lang, source, None if text is None else len(text), "x", "k", 1, 2

    rows = [
        row(1, "The cat sat on the mat and the dog ran to the far end of the garden."), row(2, "The cat sat on the mat and the dog ran to the far end of the garden."),
        row(2, "The cat sat on the mat and the dog ran to the far end of the garden."), row(3, "The  cat sat on the mat and the dog ran to the far end of the garden.\n"),
        row(4, ""), row(5, None), row(6, "  \t\n "), row(7, LONG), row(8, LONG + "tail"), row(None, "no id here"), row(None, None, None, None),
        row(9, "password = 'abcdEFGH1234' mail me@x.org call +1 (555) 123-4567 card 4111 1111 1111 1111 ip 10.0.0.1", "de", None), row(10, "日本語 ▁ x 😀 <b>", None, "s2"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
