import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rid long, row string, gid string, key string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text[, source]) with extra columns whose names the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1]), 7, "x", None, "k") for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make


LONG = "word " * 60_000
#: Nulls, empties, ties, repeated rows and a very long text.
HARD = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "a  b\tc"), (4, "   "), (5, LONG), (6, LONG + "x"), (None, None), (7, "é ß 漢字 😀")]
