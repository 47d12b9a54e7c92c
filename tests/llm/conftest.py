import pytest

from scrubwell.llm.batches import reach_workers

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def workers(spark):
    reach_workers(spark)


@pytest.fixture
def documents(spark):
    """Builds documents from (doc_id, text) or (doc_id, text, source); columns that clash with the operators' own come along."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", 0, "x", 1.0, "y", 7) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, digest string, size int"
        return spark.createDataFrame(full, schema)

    return make
