import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows, columns=DOCS):
        full = [tuple(r) + (None,) * (len(columns.split(",")) - len(r)) for r in rows]
        return spark.createDataFrame(full, columns)

    return make
