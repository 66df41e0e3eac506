import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from anchorage.llm import periods
from anchorage.llm.queries import op11_tiled_periods
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def brute(words, least=6, times=4):
    """(start, length, period) of all runs: matching stretches for every period, smallest periods only."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q) and j > i:
                root = words[i : i + q]
                if not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def solved(words, whole):
    """The same through tiles, in one piece or through the pieces of a long text."""
    own = np.array([-1, *words, -2], np.int32)
    rows = []
    if whole:
        rows = [(q, a - 1, b - 1) for q, a, b in periods.solve(own, range(periods._octaves(len(words), 4)), 0, len(own))]
    else:
        for first, last, shift, low, high, part in periods.pieces(own, 4, piece=16, tiles=2):
            rows += [(q, a + shift - 1, b + shift - 1) for q, a, b in periods.solve(part, range(low, high), first, last)]
    if not rows:
        return []
    q, a, b = np.array(rows).T
    _, q, a, b = periods.stitch(np.zeros(len(q), int), q, a, b)
    return sorted(((int(x), int(y - x + p), int(p)) for p, x, y in zip(q, a, b) if y - x + p >= max(6, 4 * p)), key=lambda r: (r[0], r[2]))


PARTS = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9)), max_size=6)


@pytest.mark.parametrize("whole", [True, False])
@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_tiles_find_all_runs(whole, parts):
    words = [w for root, many in parts for w in root * many]
    assert solved(words, whole) == brute(words)


def test_z_function():
    assert periods.z_function([1, 1, 2, 1, 1, 2, 1], 9) == [7, 1, 0, 4, 1, 0, 1]
    assert periods.z_function([], 3) == []


def texts():
    draw = random.Random(5)
    made = [None, "", " \n ", "a", "a a a a a", "a a a a a a", "b " * 60 + "c", "x y z " * 4, "x y x y"]
    for k in range(40):
        words = [draw.choice("abcdefgh") for _ in range(draw.randrange(120))]
        root = [draw.choice("abc") for _ in range(draw.randrange(1, 14))]
        at = draw.randrange(len(words) + 1)
        made.append(" \t".join(words[:at] + root * draw.randrange(1, 8) + words[at:]))
    return made


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = brute(words)
    dropped = {i for a, n, q in found for i in range(a + q, a + n)}
    return found, " ".join(w for i, w in enumerate(words) if i not in dropped)


@pytest.mark.parametrize("long", [periods.LONG, 20, 0])
def test_described_equals_brute_force(docs, long):
    rows = [(i % 45, t) for i, t in enumerate(texts())] + [(None, "q r " * 9), (None, "q r " * 9), (None, "s")]
    got = periods.described(docs(rows).withColumn("runs", F.lit(1)).withColumn("key", F.lit(2)), long=long).collect()
    want = [(d, *expected(t)) for d, t in rows]
    plain = lambda r: (str(r[0]), r[2], str(r[1]))
    told = [(r.doc_id, [(x.start, x.length, x.period) for x in r.runs or []], r.collapsed) for r in got]
    assert sorted(told, key=plain) == sorted(want, key=plain)


def test_odd_rows_and_empty_table(odd, none):
    assert periods.described(odd).count() == odd.count()
    assert periods.described(none).count() == 0


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op11_tiled_periods(spark, FOLDER).collect()}
    assert len(got) == len(rows)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    periodic = 0
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if n > 1500:
            continue  # the quadratic brute force takes too long there
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found, collapsed = expected(" ".join(words))
        own = got[doc_id]
        assert own.n_runs == len(found)
        assert own.runs_sha256 == digest("".join(f"{a},{n},{q}\n" for a, n, q in found))
        assert own.collapsed_sha256 == digest(collapsed)
        if found:
            best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
            assert (own.start, own.length, own.period, own.exponent_milli) == (*best, 1000 * best[1] // best[2])
            periodic += 1
        else:
            assert own.start is own.length is own.period is own.exponent_milli is None
    assert periodic > 5
