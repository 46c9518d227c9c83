import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, kept string"


@pytest.fixture()
def docs(spark):
    """docs(rows): a documents table of (doc_id, text), with extra columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], SCHEMA)

    return make
