import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of (doc_id, text), with an extra column and one whose name differs only in case."""

    def make(rows):
        kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, Text string, fp string, c0 string"
        return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "k", "other", "f", "z") for i, t in rows], kind)

    return make

