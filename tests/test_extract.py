from datetime import datetime as dt, timedelta

import pytest

from anchorage.operators import bag, extract, items
from helpers import rows

T0 = dt(2100, 1, 1, 12)
ANCHOR = "subject_id long, admission_id long, stay_id long, anchor_time timestamp_ntz"
THREE = "subject_id long, admission_id long, stay_id long, itemid long, charttime timestamp_ntz"


def m(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture
def anchor(frame):
    return frame([(1, 10, 100, T0), (2, 20, 200, T0)], ANCHOR)


def test_window_is_half_open(frame, anchor):
    ev = frame(
        [(1, 10, 100, i, m(t)) for i, t in enumerate([0, 1439.99, 1440, -0.01])], THREE
    )
    got = rows(extract.extract_window(ev, anchor, extract.SOURCES["input_cv"]), "item_id", "min_from_anchor")
    assert got == [("0", 0.0), ("1", 1439.99)]


def test_cascade_uses_first_non_null_key_only(frame, anchor):
    ev = frame(
        [
            (1, 10, 100, 1, m(1)),  # by stay
            (1, 10, None, 2, m(1)),  # by admission
            (1, None, None, 3, m(1)),  # by subject
            (1, 10, 999, 4, m(1)),  # stay outside the cohort: not retried
            (1, 99, None, 5, m(1)),  # admission outside the cohort: not retried
            (9, None, None, 6, m(1)),
        ],
        THREE,
    )
    got = extract.extract_window(ev, anchor, extract.SOURCES["input_cv"])
    assert rows(got, "item_id") == [("1",), ("2",), ("3",)]


def test_depth_two_never_reaches_the_subject(frame, anchor):
    ev = frame([(1, None, None, 3, m(1))], THREE)
    assert extract.join_anchor(ev, anchor, ("stay_id", "admission_id")).count() == 0


def test_duplicate_anchor_keys_are_found(frame, anchor):
    assert extract.duplicated_anchor_keys(anchor, ["subject_id", "stay_id"]).count() == 0
    twice = anchor.unionByName(anchor.filter("subject_id = 1"))
    assert rows(extract.duplicated_anchor_keys(twice, ["stay_id"])) == [("stay_id", "100", 2)]


def test_dated_and_timed_microbiology(frame, anchor):
    schema = (
        "subject_id long, admission_id long, spec_itemid long, org_itemid long, ab_itemid long, "
        "charttime timestamp_ntz, chartdate timestamp_ntz"
    )
    day = dt(2100, 1, 1)
    ev = frame(
        [
            (1, 10, 7, None, 9, m(5), day),
            (1, 10, 7, 8, None, None, day),
            (1, None, 6, 6, 6, None, day),
            (1, 10, 5, 5, 5, None, day + timedelta(days=1)),
        ],
        schema,
    )
    timed = extract.extract_window(ev, anchor, extract.SOURCES["microbiology_timed"])
    dated = extract.extract_window(ev, anchor, extract.SOURCES["microbiology_dated"])
    assert rows(timed, "item_id", "min_from_anchor") == [("7,,9", 5.0)]
    assert rows(dated, "item_id", "days_from_anchor") == [("6,6,6", 0), ("7,8,", 0)]


def test_drug_phases(frame, anchor):
    schema = (
        "subject_id long, admission_id long, stay_id long, drug_name string, route string, "
        "startdate timestamp_ntz, enddate timestamp_ntz"
    )
    d0, d1 = dt(2100, 1, 1), dt(2100, 1, 2)
    ev = frame([(1, 10, 100, '"Aspirin"', "PO", d0, d1), (1, 10, None, "Saline", None, d0, d0)], schema)
    got = extract.extract_window(ev, anchor, extract.SOURCES["drug"])
    assert rows(got, "item_id") == [("Aspirin,PO,start",), ("Saline,,end",), ("Saline,,start",)]
    kept = bag.clean_bag_items(bag.bag_of_events(got))
    assert rows(kept, "item_id") == [("Aspirin,PO,start",), ("Saline,,start",)]


def test_union_drops_repeats_before_counting(frame):
    timed = frame([(1, "a", 1.0), (1, "a", 1.0), (1, "a", 2.0)], "subject_id long, item_id string, min_from_anchor double")
    dated = frame([(1, "a", 0), (1, "a", 0)], "subject_id long, item_id string, days_from_anchor int")
    united = extract.unite_events([timed, dated])
    assert united.count() == 3
    assert rows(bag.bag_of_events(united)) == [(1, "a", 3)]


def test_events_before_end(frame):
    ev = frame(
        [(1, "in", 59.0, None), (1, "at", 60.0, None), (1, "d0", None, 0), (1, "d1", None, 1), (2, "x", 1.0, None)],
        "subject_id long, item_id string, min_from_anchor double, days_from_anchor int",
    )
    profile = frame([(1, 60.0), (2, None)], "subject_id long, min_to_end double")
    assert rows(extract.events_before_end(ev, profile), "item_id") == [("d0",), ("in",)]
    assert rows(extract.events_before_end(ev, profile, 1440), "item_id") == [("in",)]


def test_generic_names(frame):
    rx = frame(
        [(1, "d", "g"), (1, "d", "g"), (1, "d", ""), (1, "e", None)],
        "subject_id long, drug string, drug_name_generic string",
    )
    assert rows(extract.generic_names(rx), "drug_name") == [("d",), ("g",)]


def test_value_tokens(frame):
    ev = frame(
        [(1, "5", "Abc"), (2, "5", "12.5"), (3, "5", None), (4, "5", "a, b"), (5, "6", "abc"), (6, "5", "ABC 9")],
        "subject_id long, item_id string, value string",
    )
    dictionary = items.value_dictionary(ev)
    assert rows(dictionary, "item_id", "value") == [("5", "a  b"), ("5", "abc"), ("5", "abc "), ("6", "abc")]
    assert {r.k for r in dictionary.filter("item_id = '5'").collect()} == {1, 2, 3}
    got = {r.subject_id: r.item_id for r in items.tokenise_values(ev, dictionary).collect()}
    assert got[2] == got[3] == "5"
    assert got[5] == "6_1" and got[1].startswith("5_") and got[1] != got[6]
    assert rows(items.valued_items(dictionary)) == [("5",), ("6",)]
    labels = items.value_labels(dictionary, frame([("5", "Heart"), ("6", "Lung")], "item_id string, label string"))
    assert "Lung abc" in {r.label for r in labels.collect()}
    plain = frame([("5", "Heart"), ("7", "Skin")], "item_id string, label string")
    assert len(rows(items.items_with_values(plain, labels))) == 5


def test_chart_items_keep_null_link(frame):
    d = frame(
        [("1", "carevue", None), ("2", "carevue", "microbiologyevents"), ("3", "metavision", "chartevents")],
        "item_id string, system string, linksto string",
    )
    assert rows(items.chart_items(d), "item_id") == [("1",), ("3",)]
    assert rows(items.chart_items(d, "carevue"), "item_id") == [("1",)]
