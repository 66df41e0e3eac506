import random

import pytest
from pyspark.sql import functions as F

from anchorage.operators import concepts, vocabulary
from helpers import rows

SPANS = "doc_id string, concept_id string, begin int, end int"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def near_words(rng, alphabet, size, length):
    made = set()
    while len(made) < size:
        w = [rng.choice(alphabet) for _ in range(rng.randrange(*length))]
        made.add("".join(w))
    return sorted(made)


def edited(rng, word):
    w = list(word)
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(w) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            w.insert(i, rng.choice("abcé"))
        elif w and kind == 1:
            w.pop(min(i, len(w) - 1))
        elif w:
            w[min(i, len(w) - 1)] = rng.choice("abcé")
    return "".join(w)


def words_and_vocabulary(seed):
    rng = random.Random(seed)
    vocab = near_words(rng, "abcé", 60, (1, 14)) + near_words(rng, "abcdefgh", 15, (20, 45))
    return sorted({edited(rng, w) for w in vocab for _ in range(3)} - {""}), vocab


@pytest.mark.parametrize("k", [1, 2, 3, 5, 9])
def test_candidates_are_all_pairs_within_reach(frame, k):
    probes, vocab = words_and_vocabulary(k)
    got = vocabulary.candidate_pairs(
        frame([(w,) for w in probes], "word string"), frame([(w,) for w in vocab], "word string"), k
    )
    all_ = ((a, b, levenshtein(a, b)) for a in probes for b in vocab if len(a) > 1)
    assert sorted(tuple(r) for r in got.collect()) == sorted(x for x in all_ if x[2] <= min(k, len(x[0]) - 1))


@pytest.mark.parametrize("k", [None, 2])
def test_nearest_words_at_any_distance(frame, k):
    probes, vocab = words_and_vocabulary(11)
    probes = sorted({*probes, "q", "xyxyxyxyxyxyxyxya", "hhhhhhhh"})
    got = vocabulary.nearest_words(
        frame([(w,) for w in probes], "word string"), frame([(w,) for w in vocab], "word string"), k
    )
    best = {a: min((levenshtein(a, b), b) for b in vocab) for a in probes}
    want = [(a, m, d) for a, (d, m) in best.items() if 1 < len(a) > d and (k is None or d <= k)]
    assert rows(got, "word", "match", "distance") == sorted(want)


def test_best_match_rules(frame):
    pairs = frame(
        [
            ("heart", "hart", 1, 1),
            ("heart", "heard", 1, 0),  # preferred list wins the tie
            ("ab", "cd", 2, 0),  # not closer than the word is long
            ("lung", "lunge", 1, 0),
            ("lung", "bung", 1, 0),  # alphabetical at full tie
        ],
        "word string, match string, distance int, preferred int",
    )
    assert rows(vocabulary.best_matches(pairs), "word", "match") == [("heart", "heard"), ("lung", "bung")]


def test_correction(frame):
    observed = frame([(w,) for w in ("heart", "hearrt", "icu", "zzzzzz", "english")], "word string")
    medical = frame([("heart",), ("ICU",)], "word string")
    general = frame([("english",)], "word string")
    got = dict(rows(vocabulary.correct_spelling(observed, medical, general)))
    assert got == {"heart": "heart", "hearrt": "heart", "icu": "icu", "zzzzzz": "zzzzzz", "english": "english"}


def test_consolidation(frame):
    items = frame(
        [(999, "Hearrt Rate"), (1000, "heart rate"), (5, "Lung"), (6, None), (7, "")], "item_id long, label string"
    )
    medical = frame([("heart",), ("rate",), ("lung",)], "word string")
    got = vocabulary.consolidate_corrected(items, medical)
    assert rows(got, "item_id", "cleaned", "label", "canonical_id") == [
        ("1000", "heart rate", "heart rate", "1000"),
        ("5", "lung", "lung", "5"),
        ("999", "hearrt rate", "heart rate", "1000"),  # '1000' < '999' as text
    ]
    assert rows(vocabulary.unique_items(got), "item_id") == [("1000",), ("5",)]
    assert rows(vocabulary.corrections(got))[2] == ("999", "hearrt rate", "heart rate")
    clean = vocabulary.consolidate_clean(items)
    assert rows(clean, "item_id", "canonical_id") == [("1000", "1000"), ("5", "5"), ("999", "999")]


def test_vocabulary_sources(frame):
    text = frame([("Heart, (L) 5 x.y",), (None,)], "t string")
    label = rows(vocabulary.source_words(text, "t"))
    assert label == [("5",), ("heart",), ("left",), ("x.y",)]
    assert ("x",) in rows(vocabulary.source_words(text, "t", "code"))
    plain = vocabulary.source_words(frame([("NaCl",), (None,)], "t string"), "t", "plain")
    built = vocabulary.build_vocabulary([vocabulary.source_words(text, "t"), plain])
    assert rows(built) == [("NaCl",), ("heart",), ("left",), ("x.y",)]


def test_staging_and_drug_labels(frame):
    drugs = vocabulary.drug_labels(frame([("NS", "IV", "start")], "drug_name string, route string, start string"))
    assert rows(drugs) == [("NS,IV,start", "normal saline solution,IV,start")]
    pair = "item_id string, label string"
    staged = vocabulary.staged_documents(
        frame([("1,,2", "(a,b)")], pair),
        drugs,
        frame([("9", "Hi: [x]", "hi: x")], "item_id string, original string, corrected string"),
        frame([("50", "Na", None, "Chem.")], "item_id string, label string, fluid string, category string"),
    )
    got = {r.family: r.text for r in staged.collect()}
    assert got == {
        "microbiology": " a,b ",
        "drug": "normal saline solution,IV,start",
        "chart": "Hi   x \nhi: x",
        "lab": "Na  Chem ",
    }
    names = vocabulary.drug_document_names(drugs)
    docs = frame([(names.first()["doc_id"],), ("77",)], "doc_id string")
    assert rows(concepts.with_original_ids(docs, names), "item_id") == [("77",), ("NS,IV,start",)]


def test_annotation(frame):
    docs = frame(
        [("d1", "Chronic heart failure; the failure of hearts."), ("d2", ""), ("d3", None)], "doc_id string, text string"
    )
    dictionary = frame(
        [("heart failure", "C1"), ("chronic failure heart", "C2"), ("the", "C3"), ("failure", "C4"), ("a b c d e f g h", "C5")],
        "text string, concept_id string",
    )
    excluded = frame([("The",)], "word string")
    got = rows(concepts.annotate(docs, dictionary, excluded))
    # later tokens may come in any order, the first may not move
    assert got == [
        ("d1", "C1", 8, 21),
        ("d1", "C2", 0, 21),
        ("d1", "C4", 14, 21),
        ("d1", "C4", 27, 34),
    ]


def greedy(spans):
    kept = set()
    out = set()
    for cui, b, e in sorted(spans, key=lambda s: s[1] - s[2]):
        inside = any((b >= x and e < y) or (b > x and e <= y) for x, y in kept)
        if not inside:
            kept.add((b, e))
            out.add(cui)
    return out


@pytest.mark.parametrize("chunk", [4, 4096])
def test_spanning_equals_greedy(frame, chunk):
    rng = random.Random(chunk)
    docs = {}
    for d in range(150):
        docs[f"d{d}"] = {
            (f"C{rng.randrange(9)}", b, b + rng.randrange(1, 7))
            for b in (rng.randrange(14) for _ in range(rng.randrange(1, 9)))
        }
    df = frame([(d, *s) for d, ss in docs.items() for s in ss], SPANS)
    outer = concepts.outermost_spans(df, chunk)
    got = rows(df.join(outer, ["doc_id", "begin", "end"], "left_semi").select("doc_id", "concept_id").distinct())
    assert got == sorted((d, c) for d, ss in docs.items() for c in greedy(ss))


def test_methods(frame):
    df = frame(
        [("d", "A", 0, 10), ("d", "B", 0, 10), ("d", "C", 0, 4), ("d", "D", 6, 10), ("d", "E", 12, 14)], SPANS
    )
    table = concepts.item_concepts(df)
    picked = {m: [r.concept_id for r in concepts.choose_method(table, m).orderBy("concept_id").collect()] for m in concepts.METHODS}
    assert picked == {"all": list("ABCDE"), "spanning": ["A", "B", "E"], "longest": ["A", "B"]}
    assert rows(concepts.concept_counts(table)) == [("d", "all", 5), ("d", "longest", 2), ("d", "spanning", 3)]
    with pytest.raises(ValueError):
        concepts.choose_method(table, "best")


def test_semantic_groups(spark, frame):
    d = frame([("C1", "T047"), ("C2", "T022"), ("C3", "T999")], "concept_id string, tui string")
    got = rows(concepts.group_concepts(d, concepts.semantic_groups(spark)), "concept_id", "concept_group")
    assert got == [("C1", "disorder"), ("C2", "anatomy"), ("C2", "finding")]


def test_phrases_of_any_length_are_found(frame):
    phrase = "one two three four five six seven eight nine"
    docs = frame([(1, f"say {phrase} now"), (2, "one nine eight seven six five four three two")], "doc_id long, text string")
    dictionary = frame([("C1", phrase), ("C2", "seven eight")], "concept_id string, text string")
    found = rows(concepts.annotate(docs, dictionary), "doc_id", "concept_id")
    assert found == [(1, "C1"), (1, "C2"), (2, "C1")]
    short = rows(concepts.annotate(docs, dictionary, max_window=7), "doc_id", "concept_id")
    assert short == [(1, "C2")]


@pytest.mark.parametrize("chunk", [4, 4096])
def test_spanning_concepts_are_those_of_outermost_spans(frame, chunk):
    rng = random.Random(chunk)
    data = []
    for i in range(400):
        begin = rng.randrange(40)
        data.append((i % 3, f"c{i % 60}", begin, begin + rng.randrange(1, 9)))
    spans = frame(data, "doc_id long, concept_id string, begin int, end int")
    want = {
        (d, c)
        for d, c, b, e in data
        if not any(x == d and y <= b and e <= z and z - y > e - b for x, _, y, z in data)
    }
    assert set(rows(concepts.concepts_spanning(spans, chunk))) == want
