import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with columns whose names the operators also use."""

    def make(texts, ids=None):
        schema = "doc_id long, text string, lang string, h long, n long, nid long, `_id` long, `row` string, bucket long, spans string, found string, kept boolean, key double"
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", 1, 2, 3, 4, "r", 5, "s", "f", True, 0.5) for i, t in zip(ids, texts, strict=True)], schema)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
