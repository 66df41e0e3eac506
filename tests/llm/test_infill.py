import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from anchorage.llm import infill
from anchorage.llm.common import utf8
from anchorage.llm.queries import op12_exception_index_infill


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aé€😀\0 ", max_size=20), min_size=1, max_size=5))
def test_index_converts_both_ways(texts):
    for text, index in zip(texts, infill.exceptions(*utf8(pa.array(texts)))):
        places = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
        chars = np.arange(len(text) + 1)
        assert index.to_bytes(chars).tolist() == places.tolist()
        assert index.to_chars(places).tolist() == chars.tolist()
        assert index.chars.size == sum(len(c.encode()) > 1 for c in text)


def brute(doc_id, text):
    """The same by plain strings: (n, form, prefix, middle, output)."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


TEXTS = ["", None, "plain words", "é€😀" * 9, "a <S> inside", "< S> <", "<P", "\0 \t\n", "x" * 9000 + "ß", "one", "one"]


def test_transform_equals_brute_force_and_restores(spark, docs):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(220)] + [(None, "without an id: é"), (3, TEXTS[3])]
    made = infill.transform(docs(rows)).withColumn("back", infill.restored()).collect()
    assert len(made) == len(rows)
    key = lambda r: (str(r[0]), r[1] or "")
    for row, (doc_id, text) in zip(sorted(made, key=lambda r: key((r.doc_id, r.back))), sorted(rows, key=key)):
        assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == brute(doc_id, text)
        assert row.back == (text or "")
        if row.form != "plain":
            assert row.prefix_bytes == len(text[: row.prefix_chars].encode())
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_odd_rows_and_empty_table(odd, none):
    assert infill.transform(odd).count() == odd.count()
    assert infill.transform(none).count() == 0


@pytest.mark.parametrize("column", ["form", "h1", "output"])
def test_clashing_columns(docs, column):
    from pyspark.sql import functions as F

    made = infill.transform(docs([(1, "some words")]).withColumn(column, F.lit(7)))
    assert made.columns[0] == "doc_id" and made.count() == 1


def test_query_restores_every_text(spark):
    out = op12_exception_index_infill(spark, "/root/testdata/sf0.001").collect()
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    plain = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in texts}
    assert {r.doc_id: r.restored_sha256 for r in out} == plain
