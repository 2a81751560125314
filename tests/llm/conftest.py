import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes ``documents`` rows of (doc_id, text, source)."""

    def make(rows, extra=()):
        df = spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in rows], DOCUMENTS)
        for name in extra:
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
