import pytest


@pytest.fixture
def odd_docs(spark):
    """Rows with nulls, empty and repeated texts, ties, and columns named like the operators' own."""
    def make(texts, **more):
        rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0]), (len(texts), None), (len(texts) + 1, "")]
        columns = "doc_id long, text string, words int, place string, score string, h1 int, fp int, shard int, n int, line int"
        return spark.createDataFrame([(*r, 1, "p", "s", 1, 1, 1, 1, 1) for r in rows], columns)
    return make
