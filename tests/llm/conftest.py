import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string"


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text[, lang, source]) as documents with two columns whose names clash."""

    def make(rows):
        full = [(*r, *["en", "a"][len(r) - 2 :])[:4] for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y") for r in full], DOCS)

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty, blank and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} stem{i}" for i in range(6000))
    again = "the same words are said once more here, and then again"
    return docs(
        [(1, None, None, None), (2, ""), (3, " \n\t "), (4, long), (5, again), (6, again), (6, again), (7, "A b\0c</s>", "de", None)]
        + [(8, "one")]
    )


@pytest.fixture
def none(docs):
    return docs([(0, "x")]).where("doc_id < 0")
