import hashlib
import random
from collections import Counter

import pytest

from anchorage.llm import merkle, mixing, sharding, superminhash as sm


def brute(texts):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        n = min(4, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    parent = {k: k for k in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_groups_equal_brute_force(docs, none):
    rng, texts = random.Random(5), {}
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((3, 30, 120)))]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
            texts[len(texts)] = " ".join(own)
    texts |= {200: None, 201: "", 202: " \n", 203: "ONE two", 204: "one TWO", 205: "Ä b", 206: "ä b"}
    got = sm.groups(docs(list(texts.items()))).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert sm.groups(none).count() == 0


def test_deduplicated_keeps_one_row_each(odd):
    rows = sm.deduplicated(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([1, 2, 3, 4, 5, 7, 8])
    assert rows[0].asDict().keys() == set(odd.columns)


def test_rows_without_an_id_are_kept_and_linked(docs):
    texts = [" ".join(f"{k}{i}" for i in range(60)) for k in "abc"]
    near = texts[0].replace("a59", "z")
    rows = docs([(None, texts[0]), (None, texts[0]), (None, near), (None, texts[1]), (None, texts[2]), (7, texts[2]), (None, None), (None, " ")])
    got = Counter(r["text"] for r in sm.deduplicated(rows).collect())
    assert sum(got[t] for t in (texts[0], near)) == 1
    assert all(got[t] == 1 for t in (texts[1], texts[2], None, " ")) and sum(got.values()) == 5
    told = sm.groups(rows).collect()
    assert len(told) == 8 and {r["component_id"] for r in told} == {None, 7} and {r["doc_id"] for r in told} == {None, 7}
    assert Counter(r["text"] for r in mixing.mix(rows.where("text is not null")).collect()).keys() >= {texts[1], near}


def test_pipeline_takes_five_word_shingles(docs, spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    other = [f"x{i}" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(words)]
    rows = docs([(1, " ".join(words)), (2, " ".join(other))])
    assert corpus_pipeline.drop_near_duplicates(spark, rows, "").count() == 2 and sm.deduplicated(rows).count() == 1


@pytest.mark.parametrize("sizes", [[], [5], [8, 7, 6, 5, 4], [100, 1, 1, 1, 1, 1], list(range(1, 200))])
def test_differencing(sizes):
    placed = sharding.differencing(sizes, 3)
    sums = [sum(n for n, k in zip(sizes, placed) if k == s) for s in range(3)]
    assert max(sums) - min(sums) <= max(sizes, default=0)
    if len(sizes) == 199:
        assert max(sums) - min(sums) <= 1


def test_shards_of_odd_rows(odd, none):
    rows = sharding.shard_by_bytes(odd, 3).collect()
    assert len(rows) == odd.count() and len({r["shard"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    for s in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(none).count() == 0


def test_mix_meets_targets(docs, none):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(300)]
    plan = mixing.plan(docs(rows)).collect()
    for source in ("a", "b", None):
        own = [r for r in plan if r["source"] == source]
        taken = sum(d["words"] for r in own for d in r["draws"])
        assert abs(taken - own[0]["target"]) <= 0.5
        assert all(sum(d["words"] for d in r["draws"]) <= 3 * r["size"] for r in own)
    mixed = mixing.mix(docs(rows)).collect()
    assert sum(len((r["text"] or "").split()) for r in mixed) == sum(d["words"] for r in plan for d in r["draws"])
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_mix_of_odd_rows(odd):
    assert mixing.plan(odd).count() == odd.count()
    assert set(mixing.mix(odd).columns) == set(odd.columns)


def test_splitting_tree_is_exact(spark):
    draws = spark.createDataFrame([("a", 50), ("b", 7), (None, 43)], "source string, draws long")
    rows = mixing.split(draws, 5).collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["last"] - r["first"] + 1
    assert sum(size.values()) == 100 and max(size.values()) - min(size.values()) <= 1
    for source, n in (("a", 50), ("b", 7), (None, 43)):
        own = sorted((r["first"], r["last"]) for r in rows if r["source"] == source)
        assert [x for a, b in own for x in range(a, b + 1)] == list(range(n))


def test_merkle_of_odd_rows(odd, none):
    got = {(r["doc_id"], r["edited_sha256"], r["n_chars"]) for r in merkle.compare_edited(odd).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), reverse=True)
    want = set()
    for i, (doc, text) in enumerate(rows):
        n, following = len(text) // 3, rows[(i + 1) % len(rows)][1]
        want.add((doc, hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest(), len(text)))
    assert got == want
    assert merkle.compare_edited(none).count() == 0


def test_merkle_locates_edits(docs):
    text = "\n".join(f"paragraph {i} has some words of its own, {i * i} of them" for i in range(30))
    pair = docs([(1, text), (2, text.replace("paragraph 17", "section 17"))])
    a, b = (pair.where(f"doc_id = {k}").select(merkle.tree(pair["text"]).alias(f"t{k}")) for k in (1, 2))
    both = a.join(b).select(merkle.differing(a["t1"], b["t2"]).alias("d"), merkle.likeness(a["t1"], b["t2"]).alias("l")).first()
    assert both["d"] == [17] and 0.9 < both["l"] < 1
    prints = merkle.fingerprints(docs([(1, text), (2, text), (3, text + " ")])).select("fingerprint").distinct()
    assert prints.count() == 2
