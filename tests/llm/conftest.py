"""Small documents for the operators of the optional subpackage."""

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, extra=""):
        rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in texts]
        return spark.createDataFrame(rows, DOCS)

    return make
