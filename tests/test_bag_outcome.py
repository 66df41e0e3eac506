import pytest

from anchorage.operators import bag, outcome
from helpers import rows

BAG = "subject_id long, item_id string, cnt long"
PROFILE = "subject_id long, unit string, severity double, min_to_end double, min_to_death double"


def test_singletons(frame):
    ev = frame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "subject_id long, item_id string")
    assert rows(bag.bag_of_events(ev)) == [(1, "a", 2), (2, "a", 1), (2, "b", 1)]
    assert rows(bag.bag_of_events(ev, drop_singletons=True)) == [(2, "a", 1), (2, "b", 1)]


def test_threshold_is_strict(frame):
    b = frame([(s, "at", 1) for s in range(4)] + [(s, "over", 1) for s in range(5)], BAG)
    assert {r.item_id for r in bag.frequent_items(b, 4).collect()} == {"over"}
    eligible = frame([(s,) for s in range(4)], "subject_id long")
    assert bag.filter_bag(b, eligible, 4).count() == 0


def test_concept_rollup_and_inverse(frame):
    b = frame([(1, "x", 2), (1, "y", 3), (2, "z", 1)], BAG)
    m = frame([("x", "C1"), ("x", "C2"), ("y", "C1"), ("y", "C1")], "item_id string, concept_id string")
    assert rows(bag.concept_rollup(b, m)) == [(1, "C1", 5), (1, "C2", 2)]
    assert rows(bag.subject_spine(b)) == [(1,), (2,)]
    assert rows(bag.concept_items(m)) == [("C1", "x", 2), ("C1", "y", 2), ("C2", "x", 1)]
    keyed = frame([('("a",b)', "C1"), ("n", None)], "item_id string, concept_id string")
    assert rows(bag.mapped_item_ids(keyed)) == [("a,b",)]


def test_shared_items_and_drop(frame):
    a = frame([(1, "x", 1), (1, "y", 0)], BAG)
    b = frame([(2, "x", 1), (2, "y", 1)], BAG)
    assert rows(bag.shared_items(a, b)) == [("x",)]
    assert bag.drop_subjects(a, frame([(1,)], "subject_id long")).count() == 0


def test_criteria(frame):
    p = frame([(1, "CCU", 0.0, 1.0, None), (2, "MICU", 0.0, 1.0, None)], PROFILE)
    s = frame([(1,), (1,), (3,)], "subject_id long")
    assert rows(bag.subjects_by_criteria(p, s, {"unit": ["CCU", "MICU"]})) == [(1,)]
    with pytest.raises(ValueError):
        bag.subjects_by_criteria(p, s, {"ward": ["x"]})


def test_vectors_keep_empty_rows(frame):
    b = frame([(1, "a", 2), (1, "b", 3)], BAG).withColumnRenamed("cnt", "weight")
    index = bag.feature_index(b)
    spine = frame([(1,), (2,)], "subject_id long")
    got = {r.subject_id: r.features for r in bag.bag_vectors(b, index, spine).collect()}
    assert got[1].size == 2 and sorted(got[1].values) == [2.0, 3.0]
    assert got[2].numNonzeros() == 0


def test_outcome_labels(frame):
    p = frame(
        [(1, "u", 0.0, 10.0, None), (2, "u", 0.0, 10.0, 10.0), (3, "u", 0.0, 10.0, 11.0), (4, "u", 0.0, 50.0, None)],
        PROFILE,
    )
    died = outcome.label_outcome(p, outcome.EVENT_BEFORE_END)
    assert rows(died, "subject_id", "label") == [(1, -1), (2, 1), (3, -1), (4, -1)]
    # P75 of 10, 10, 10, 50 is 20
    long = outcome.label_outcome(p, outcome.LONG_STAY)
    assert rows(long, "subject_id", "label") == [(1, -1), (2, -1), (3, -1), (4, 1)]
    with pytest.raises(ValueError):
        outcome.label_outcome(p, "other")


def test_eligibility_edges(frame):
    p = frame(
        [
            (1, "u", 0.0, 101.0, None),
            (2, "u", 0.0, 100.0, None),  # end equals info + gap
            (3, "u", 0.0, 500.0, 100.0),  # death equals info + gap
            (4, "u", 0.0, 500.0, 101.0),
            (5, "u", 0.0, None, None),
        ],
        PROFILE,
    )
    got = outcome.eligible_subjects(p, outcome.EVENT_BEFORE_END, (0, 1), info=100)
    assert rows(got) == [(1, 0.0), (4, 0.0), (5, 0.0), (5, 1.0)]
    # cutoff is P75 of 100, 101, 500, 500 = 500: subject 4 dies before it
    long = outcome.eligible_subjects(p, outcome.LONG_STAY, (0,), info=100)
    assert rows(long) == [(1, 0.0), (5, 0.0)]


def test_population_counts(frame):
    p = frame([(1, "u", 1.0, 10.0, 5.0), (2, "v", 2.0, 10.0, None), (3, "u", 3.0, 9.0, None)], PROFILE)
    s = frame([(1,), (2,)], "subject_id long")
    people = outcome.population(p, outcome.EVENT_BEFORE_END, s, ["u"])
    assert rows(people) == [(1, "u", 1.0, 1)]
    assert rows(outcome.cohort_counts(people, ["unit"])) == [("u", 1, 1)]


def test_ids_that_become_one_are_counted_together(frame):
    counted = [(1, '("a","b",start)', 2), (1, "a,b,start", 3), (1, "a,b,end", 5), (2, "a,b,start", 1), (2, "x", 4)]
    got = bag.clean_bag_items(frame(counted, "subject_id long, item_id string, cnt long"))
    assert rows(got, "subject_id", "item_id", "cnt") == [(1, "a,b,start", 5), (2, "a,b,start", 1), (2, "x", 4)]
