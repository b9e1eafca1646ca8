import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with the other columns, and some whose names clash with ours."""

    def make(rows, extra=True):
        full = [(i, t, "en", "src", None if t is None else len(t), 1, "x") for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, size int, label string"
        df = spark.createDataFrame(full, schema).repartition(3)
        return df if extra else df.drop("size", "label")

    return make
