import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, bits long, score double, label int"


@pytest.fixture
def documents(spark):
    """Builds a documents table whose further columns clash with names the operators use."""

    def build(rows):
        full = [(i, t, (rest or ["en"])[0], "s", None, None, 7, 0.5, 1) for i, t, *rest in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


#: NULL and empty texts, ties, repeated rows, a NULL id, white space only, a text without white space, a very long text.
ODD = [(1, None), (2, ""), (3, "same words here again"), (4, "same  words\there again"), (4, "same  words\there again"), (None, "same words here again"),
       (None, None), (7, " \t\n"), (8, "x" * 50_000), (9, "word " * 60_000), (10, "Ünïcödé ​ 中文 \U0001F600 123"), (11, "\x1c\x00odd\x85")]
