import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, loss int"


@pytest.fixture
def make_docs(spark):
    """A documents table from (doc_id, text, source) rows, with extra columns whose names clash with results."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 1) for i, t, s in rows], DOCS)

    return make
