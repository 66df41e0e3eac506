"""Columns of the input whose names the operators use themselves, unknown layouts, rows without an id."""

import json

import pytest
from pyspark.sql import functions as F

from anchorage.llm import chat, infill, mixing, packing, periods, sharding, suffixes, superminhash
from anchorage.llm.queries import vocabulary

CLASHING = ("_size", "_id", "_key", "_kept", "_plans", "length", "id", "row", "key", "plans", "kept", "draw", "first", "band", "n")


@pytest.fixture
def clashing(docs):
    texts = ["some words of a text that is told", "some other words here", None, "", "a b c d e f g h i j k l"]
    df = docs([(i, t, "en", "ab"[i % 2]) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1])])
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.mark.parametrize("operator", [mixing.mix, superminhash.deduplicated])
def test_columns_of_clashing_names_stay_as_they_are(clashing, operator):
    out = operator(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHING)


@pytest.mark.parametrize(
    "operator",
    [
        lambda d: superminhash.groups(d),
        lambda d: sharding.shard_by_bytes(d, 3),
        lambda d: packing.pack(d, vocabulary("byte_bpe_50k.json")),
        lambda d: mixing.plan(d),
        infill.transform,
        periods.described,
        suffixes.without_repeats,
    ],
)
def test_rows_without_an_id_and_clashing_columns_are_told(clashing, operator):
    assert operator(clashing).where("doc_id is null").count() == 2


def test_unknown_layouts_are_told_and_others_go_on(frame):
    known = [
        {"conv_id": 1, "prompt": "p", "response": "r"},
        {"conv_id": 2, "prompt": "p", "response": "r", "system": "s", "id": 9, "source": {"name": "x"}},
        {"conv_id": 3, "messages": []},
        {"conv_id": 4, "messages": [{"role": "user", "content": "u", "name": "n"}]},
    ]
    raw = [json.dumps(r) for r in known] + ['{"conv_id": 5, "said": "x"}', "not json", "[1]", '{"conv_id": "six", "prompt": "p", "response": "r"}', None]
    df = frame([(r,) for r in raw], "record string")
    got = sorted((r.conv_id, r.role, r.text) for r in chat.turns(df).collect())
    assert got == [(1, "assistant", "r"), (1, "user", "p"), (2, "assistant", "r"), (2, "system", "s"), (2, "user", "p"), (4, "user", "u")]
    told = {r.record: r.reason for r in chat.unmapped(df).collect()}
    assert set(told) == set(raw[4:8]) and all(told.values()) and "said" in told[raw[4]]
