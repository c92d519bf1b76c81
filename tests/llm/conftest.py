import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, pattern string, fp string"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, source]), with columns whose names operators also use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), -1, "x", "y") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


EDGES = [
    (0, None), (1, ""), (2, "one"), (3, "two words"), (4, "\t \n"), (5, "same text here again and again"),
    (6, "same text here again and again"), (7, "word " * 5000), (8, "naïve ñandú 漢字 \U0001F600 <|endoftext|> end"),
    (9, "x" * 3000), (10, "it's   odd space\x1c　 123 ½ ²"),
]
