import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, id long, bucket int, row string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names operators use themselves."""

    def made(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 8, "x") for i, t in rows], DDL)

    return made
