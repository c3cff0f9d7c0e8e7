import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, base string, _times int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with two extra columns whose names clash with internal ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, source, len(t or ""), "x", 1) for i, t, lang, source in rows], DOC)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, long, "en", "a"), (4, "same text here", "en", "b"), (5, "same text here", "en", "b"), (5, "same text here", "en", "b"), (6, "12 !? --", "de", "b"), (None, "no id", None, "a")]
    return docs_of(rows)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])
