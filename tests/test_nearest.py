import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from anchorage.operators import nearest, vocabulary
from helpers import rows


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, last[j + 1] + 1, last[j] + (x != y)))
    return row[-1]


WORD = st.text(alphabet="abcé\U0001f600z", min_size=1, max_size=9)


@settings(max_examples=200, deadline=None)
@given(WORD, st.lists(WORD, min_size=1, max_size=12))
def test_distances(word, words):
    own = nearest.Vocabulary(words)
    got = own.distances(word, np.arange(own.words.size))
    assert got.tolist() == [edits(word, w) for w in own.words]


@pytest.mark.parametrize("n", [63, 64, 65, 130])
def test_distances_of_long_words(n):
    own = nearest.Vocabulary(["ab" * 40, "b", "a" * n, "ab" * 31 + "x", "b" * 64])
    for word in ("a" * n, ("ab" * n)[:n]):
        assert own.distances(word, np.arange(own.words.size)).tolist() == [edits(word, w) for w in own.words]


@settings(max_examples=200, deadline=None)
@given(WORD, st.lists(WORD, max_size=12), st.one_of(st.none(), st.integers(0, 4)))
def test_nearest_is_the_first_of_the_nearest(word, words, k):
    within = len(word) - 1 if k is None else min(k, len(word) - 1)
    words = [w for w in words if w != word]  # a known word has no need of a match
    own = nearest.Vocabulary(words)
    best = min(((edits(word, w), w) for w in words), default=None)
    got = own.nearest(word, within)
    assert (got and (got[0], own.words[got[1]])) == (best if best and best[0] <= within else None)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(WORD, st.text(alphabet="ab", min_size=15, max_size=70)), min_size=1, max_size=12), st.lists(WORD, max_size=12))
def test_words_that_walk_together_find_the_same(unknown, words):
    own, within = nearest.Vocabulary(words), [len(w) - 1 for w in unknown]
    alone = nearest.ALONE
    try:
        nearest.ALONE = 0
        got = own.nearest_of_many(unknown, within)
    finally:
        nearest.ALONE = alone
    assert got == [own.nearest(w, k) for w, k in zip(unknown, within)]


@pytest.mark.parametrize("block", [100, 4])
def test_blocks_give_the_same(frame, block):
    words = ["heart", "hart", "lung", "liver", "kidney", "spleen", "aorta", "vein"]
    unknown = ["haert", "lugn", "livre", "kidny", "splen", "aort", "q", "xxxxxxxx", "veinn", "xyzhearts"]
    got = vocabulary.nearest_words(frame([(w,) for w in unknown], "word string"), frame([(w,) for w in words], "word string"), block=block)
    best = {u: min((edits(u, w), w) for w in words) for u in unknown}
    assert rows(got, "word", "match", "distance") == sorted((u, w, d) for u, (d, w) in best.items() if d < len(u))
