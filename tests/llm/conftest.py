import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a table like ``documents`` from texts or from (id, text, lang, source) rows."""

    def make(rows):
        full = [r if isinstance(r, tuple) else (k, r, "en", "a") for k, r in enumerate(rows)]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], DOCS)

    return make


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
