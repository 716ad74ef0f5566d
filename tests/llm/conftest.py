import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __salt int, score double, fp long"


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text, lang, source), with extra columns whose names operators use inside."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
        return spark.createDataFrame([(*r, len(r[1]) if r[1] else 0, 7, 0.5, 9) for r in full], DOCS)

    return make
