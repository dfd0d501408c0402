import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from `(doc_id, text)` pairs, with a column whose name may clash."""

    def make(rows, extra="n_chars long, failed string"):
        full = [(i, text, "en", "src", None if text is None else len(text), "x") for i, text in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, {extra}")

    return make
