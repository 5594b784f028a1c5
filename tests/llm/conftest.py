import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows to documents, with columns whose names an operator might use itself."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), "x", 1, True) for i, t in rows]
        return spark.createDataFrame(full, DOC + ", _row string, size long, kept boolean")

    return make
