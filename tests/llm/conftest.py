import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def frame(spark):
    """A documents table from (doc_id, text[, source]) rows, with columns whose names the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", 0, 7, "x", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA + ", rid long, __rid string, size long").coalesce(2)

    return make
