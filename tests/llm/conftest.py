import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from texts, or from (doc_id, text, lang, source) rows."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, lang, source = (i, r, None, None) if r is None or isinstance(r, str) else (*r, None, None)[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, SCHEMA)

    return make
