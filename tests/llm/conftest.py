import pytest

from dayproof.llm.common import keep_session_batches, ship_code

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def workers(spark):
    ship_code(spark)
    keep_session_batches(spark)


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, lang]) as a documents table."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
