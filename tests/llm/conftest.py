import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, n long, row string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names clash with inner ones; rows of (doc_id, text)."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1, "z") for i, t in rows], DOCS)

    return build


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
