import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents of (doc_id, text) rows, with all columns of the table."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)

    return make


@pytest.fixture
def cluttered():
    """A frame with more columns, whose names are those that the operators use inside."""
    from pyspark.sql import functions as F

    names = ["class", "key", "hi", "lo", "label_", "rank", "block", "_maps", "chunk", "n", "a", "b", "host", "path", "node", "filters", "entity", "_found", "doc", "_doc", "_gone", "x"]
    return lambda df: df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})
