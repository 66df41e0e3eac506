import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from anchorage.llm import grammar, packing, tokens
from anchorage.llm.queries import vocabulary

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def plain(name, text):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary(name))
    return own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t ab.'é12\0\x1cAZßΣ<|>,"), max_size=30))
def test_encoder_is_the_tokenizer(name, text):
    own = np.frombuffer(tokens.encoder(vocabulary(name)).encode([text])[0], "<u4").tolist()
    assert own == plain(name, text)


@pytest.mark.parametrize("name", NAMES)
def test_special_strings_inside_texts(name):
    texts = ["a<|endoftext|>b", "<|endoftext|>", " x <|ENDOFTEXT|> y", "<|startoftext|> a <|endoftext|>\n", "<|endoftext", "plain"]
    for text, ids in zip(texts, tokens.encoder(vocabulary(name)).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain(name, text)
    assert np.frombuffer(tokens.encoder(vocabulary(name)).encode(texts)[0], "<u4").tolist().count(plain(name, texts[1])[0]) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=40), min_size=1, max_size=6))
def test_grammar_round_trip(texts):
    coded = [np.array([*t, 1], "<u4").tobytes() for t in texts]
    payload = grammar.pack_block(list(range(len(texts))), coded, 8, 1)
    for i, t in enumerate(texts):
        assert grammar.decode(payload, i).tolist() == [*t, 1]
        assert grammar.decode(payload, i, 2, 5).tolist() == [*t, 1][2:5]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=200), st.sampled_from([2, 4]))
def test_no_pair_is_left_that_could_be_replaced(ids, uses):
    symbols, left, right = grammar.replace_pairs(np.array(ids, np.uint32), 6, 5, uses=uses)
    rules = dict(enumerate(zip(left.tolist(), right.tolist()), 6))

    def opened(s):
        return [s] if s < 6 else [y for x in rules[s] for y in opened(x)]

    assert [x for s in symbols.tolist() for x in opened(s)] == ids
    apart, last = {}, {}
    for i, pair in enumerate(zip(symbols.tolist(), symbols.tolist()[1:])):
        if 5 not in pair and last.get(pair) != i - 1:
            apart[pair] = apart.get(pair, 0) + 1
            last[pair] = i
    assert max(apart.values(), default=0) < uses


def test_files_of_odd_rows(odd, none):
    rows = grammar.round_trip(odd, vocabulary(NAMES[0])).orderBy("start").collect()
    texts = sorted((r["doc_id"], r["text"] or "") for r in odd.collect())
    at = 0
    for r, (doc, text) in zip(rows, texts, strict=True):
        ids = np.array([*plain(NAMES[0], text), 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, ids.size, zlib.crc32(ids.tobytes()))
        at += ids.size
    assert grammar.round_trip(none, vocabulary(NAMES[0])).count() == 0


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack(odd, vocabulary(NAMES[1]), 0, 64).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    want = sorted((r["doc_id"], len(plain(NAMES[1], r["text"] or "")) + 1) for r in odd.collect())
    assert sum(n for _, n in want) == sum(r["length"] for r in rows)
    assert packing.pack(none, vocabulary(NAMES[1])).count() == 0


def test_plan_is_best_fit_decreasing():
    histogram = {7: 3, 5: 4, 4: 2, 3: 9, 1: 5}
    slots = packing.plan(histogram, 10)
    assert sum(s.last_rank - s.first_rank + 1 for s in slots) == sum(histogram.values())
    used = 1 + max(s.first_sequence + s.last_rank - s.first_rank for s in slots)
    rooms = []
    for n in sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 10) - n)
    assert used == len(rooms)


def test_few_and_many_places_give_one_grammar(monkeypatch):
    ids = np.random.default_rng(5).integers(6, 40, 40_000).astype(np.uint32)
    ids[20_000:] = np.tile(ids[:400], 50)
    many = grammar.replace_pairs(ids, 40, 5)
    for few in (0, 1 << 30):
        monkeypatch.setattr(grammar, "FEW", few)
        assert all((a == b).all() for a, b in zip(many, grammar.replace_pairs(ids, 40, 5)))
    payload = grammar.pack_block([1, 2], [ids[:30_000].tobytes(), ids[30_000:].tobytes()], 40, 5)
    for short in (1, 2, 64, 1 << 20):
        monkeypatch.setattr(grammar, "SHORT", short)
        got = [grammar.decode(payload, k, a, b) for k, a, b in ((0, 0, None), (1, 0, None), (1, 77, 5000), (0, 9, 9))]
        assert [x.tolist() for x in got] == [ids[:30_000].tolist(), ids[30_000:].tolist(), ids[30_077:35_000].tolist(), []]


def test_a_word_is_merged_once_in_any_case_and_before_any_marks():
    path = vocabulary("word_bpe_49k.json")
    own, merged = tokens.Encoder(path), []

    class Model:
        tokenize = staticmethod(lambda word, model=own._model: merged.append(word) or model.tokenize(word))

    own._model = Model
    texts = ["ensher Ensher ENSHER, ensher$$$ Ensher.###", "Été été&&& Straße don't$$$ İx K'k Ǆa snake_ a-- 7%% Kb"]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert got == [plain("word_bpe_49k.json", x) for x in texts] and merged.count("ensher") == 1
