import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from anchorage.llm import suffixes
from anchorage.llm.queries import op13_interval_expansion_dedup

FOLDER = "/root/testdata/sf0.001"


def brute(texts, least):
    """Removed bytes of each text as a mask: every string is counted."""
    count = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    masks = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if count[t[i : i + least]] > 1:
                mask[i : i + least] = True
        masks.append(mask)
    return masks


PARTS = st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8)


@pytest.mark.parametrize("least", [3, 7, 9, 20])
@settings(max_examples=200, deadline=None)
@given(PARTS)
def test_interval_expansion_finds_all_repeats(least, parts):
    got = [np.zeros(len(p), bool) for p in parts]
    for k, first, last in zip(*suffixes.repeated(parts, least)):
        got[k][first : last + least - 1] = True
    assert all((a == b).all() for a, b in zip(got, brute(parts, least)))


@settings(max_examples=100, deadline=None)
@given(PARTS)
def test_suffix_order(parts):
    data = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
    sizes = [len(p) for p in parts]
    left = np.concatenate([np.arange(n, -1, -1) for n in sizes])
    order, rank, prefixes = suffixes.suffix_order(data, left)
    ends = np.repeat(np.cumsum(np.array(sizes) + 1) - 1, np.array(sizes) + 1)
    part = np.repeat(np.arange(len(parts)), np.array(sizes) + 1)
    plain = sorted(range(len(data)), key=lambda i: [(1, x) for x in data[i : ends[i]].tolist()] + [(0, part[i])])
    assert order.tolist() == plain
    assert rank[order].tolist() == list(range(len(data)))


@pytest.mark.parametrize("gram", [5, 8, 11, 12])
def test_contexts_hold_each_string_once_under_a_key_of_its_own(gram):
    draw, least = random.Random(gram), 12
    texts = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(60))) for _ in range(30)] + [b"a" * 90]
    starts = np.cumsum([0] + [len(t) for t in texts])
    text, first, last, key, _ = suffixes.contexts(np.frombuffer(b"".join(texts), np.uint8), starts, least, gram, 16)
    seen = [(i, p) for i, a, b in zip(text, first - starts[text], last - starts[text]) for p in range(a, b)]
    assert sorted(seen) == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - least + 1)]
    keys = {}
    for i, a, b, k in zip(text, first - starts[text], last - starts[text], key):
        for p in range(a, b):
            assert keys.setdefault(texts[i][p : p + least], k) == k


def corpus():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(20) for _ in range(4)]
    texts = [None, "", "x", "z" * 300, "z" * 130, "ab" * 90]
    for k in range(60):
        texts.append(prose(draw.randrange(12)) + draw.choice(shared)[: draw.randrange(10, 200)] + prose(draw.randrange(12)))
    return texts + texts[10:16] + [shared[0] * 3]


@pytest.mark.parametrize("most", [1024, 3, 1])
def test_without_repeats_equals_brute_force(docs, most):
    texts = corpus()
    rows = [(i % 55, t) for i, t in enumerate(texts)] + [(None, texts[8]), (None, "q" * 60), (7, texts[7]), (7, texts[7])]
    masks = brute([(t or "").encode() for _, t in rows], 40)
    frame = docs(rows).withColumn("key", F.lit(1)).withColumn("kept", F.lit("k")).withColumn("row", F.lit(0))
    got = suffixes.without_repeats(frame, 40, (16, 32, 40), most).collect()

    def want(doc_id, text, mask):
        data = np.frombuffer((text or "").encode(), np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
        return str(doc_id), len(data), list(zip(edges[::2].tolist(), edges[1::2].tolist())), data[~mask].tobytes()

    told = [(str(r.doc_id), r.n_bytes, [(s["first"], s["last"]) for s in r.spans], bytes(r.kept)) for r in got]
    assert sorted(told) == sorted(want(*r, m) for r, m in zip(rows, masks))
    assert any(m.any() and not m.all() for m in masks)


def test_odd_rows_and_empty_table(odd, none):
    assert suffixes.without_repeats(odd).count() == odd.count()
    assert suffixes.without_repeats(none).count() == 0


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    texts = [(t or "").encode() for _, t in rows]
    got = {r.doc_id: r for r in op13_interval_expansion_dedup(spark, FOLDER).collect()}
    for (doc_id, _), text, mask in zip(rows, texts, brute(texts, 400)):
        own = got[doc_id]
        kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
        assert (own.n_bytes, own.n_removed, own.n_spans) == (len(text), int(mask.sum()), len(edges) // 2)
        assert own.kept_sha256 == hashlib.sha256(kept).hexdigest()
