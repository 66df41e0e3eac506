from datetime import datetime as dt, timedelta

import pytest

from anchorage.operators import cohort
from helpers import rows

T0 = dt(2100, 1, 1)


def h(hours):
    return T0 + timedelta(hours=hours)


MOVES = (
    "subject_id long, admission_id long, stay_id long, in_time timestamp_ntz, "
    "out_time timestamp_ntz, unit string, prev_unit string, los double"
)
STAYS = "subject_id long, admission_id long, stay_id long, in_time timestamp_ntz, out_time timestamp_ntz, system string"
ADMS = (
    "subject_id long, admission_id long, admit_time timestamp_ntz, disch_time timestamp_ntz, "
    "has_ioevents_data int, has_chartevents_data int"
)
PATS = "subject_id long, gender string, dob timestamp_ntz, dod timestamp_ntz"


def world(frame):
    moves = [
        # stay 100: MICU 10 h, then SICU 8 h, then MICU for good
        (1, 10, 100, h(0), h(10), "MICU", None, 10.0),
        (1, 10, 100, h(10), h(18), "SICU", "MICU", 8.0),
        (1, 10, 100, h(18), None, "MICU", "SICU", 20.0),
        # stay 200: longest single move is in SICU, first unit is CCU
        (2, 20, 200, h(0), h(5), "CCU", None, 5.0),
        (2, 20, 200, h(5), h(20), "SICU", "CCU", 15.0),
        # starts more than a day after the anchor: not counted early
        (2, 20, 200, h(25), h(60), "CCU", "SICU", 35.0),
        # subject 3: short stay; subject 4: child
        (3, 30, 300, h(0), h(9), "CCU", None, 9.0),
        (4, 40, 400, h(0), h(90), "CCU", None, 90.0),
    ]
    stays = [
        (1, 10, 100, h(0), h(40), "carevue"),
        (1, 10, 101, h(50), h(99), "carevue"),
        (2, 20, 200, h(0), h(60), "metavision"),
        (3, 30, 300, h(0), h(9), "carevue"),
        (4, 40, 400, h(0), h(90), "carevue"),
    ]
    adms = [
        (1, 9, h(-900), h(-800), 1, 0),  # earlier, but without chart data
        (1, 10, h(-1), h(99), 1, 1),
        (1, 11, h(500), h(600), 1, 1),
        (2, 20, h(-1), h(70), 1, 1),
        (3, 30, h(-1), h(10), 1, 1),
        (4, 40, h(-1), h(91), 1, 1),
    ]
    pats = [
        (1, "F", dt(2050, 5, 5), None),
        (2, "M", dt(2050, 5, 5), h(30)),
        (3, "M", dt(2050, 5, 5), None),
        (4, "F", dt(2090, 5, 5), None),
    ]
    return (
        frame(moves, MOVES),
        frame(stays, STAYS),
        frame(adms, ADMS),
        frame(pats, PATS),
    )


def test_dominant_unit_is_longest_single_move(frame):
    moves, stays, _, _ = world(frame)
    got = {r.stay_id: (r.unit, r.time_spent) for r in cohort.dominant_unit(moves, stays).collect()}
    # null out time is capped at one day; MICU totals 16 h over two moves
    assert got[100] == ("MICU", 16 * 60)
    assert got[200] == ("SICU", 15 * 60)
    assert got[300] == ("CCU", 9 * 60)


def test_dominant_unit_tie_and_sum(frame):
    moves = frame(
        [
            (1, 1, 1, h(6), h(12), "B", None, 6.0),
            (1, 1, 1, h(0), h(6), "A", None, 6.0),
            (1, 1, 1, h(12), h(16), "B", None, 4.0),
        ],
        MOVES,
    )
    stays = frame([(1, 1, 1, h(0), h(30), "x")], STAYS)
    assert cohort.dominant_unit(moves, stays).first()["unit"] == "A"
    assert cohort.dominant_unit(moves, stays, by="sum").first()["unit"] == "B"
    with pytest.raises(ValueError):
        cohort.dominant_unit(moves, stays, by="mean")


def test_first_stays_filters(frame):
    moves, stays, adms, pats = world(frame)
    got = rows(cohort.first_stays(moves, stays, adms, pats), "subject_id", "stay_id", "early_unit", "age")
    # 3 is too short, 4 too young; 1's undocumented admission does not count
    assert got == [(1, 100, "MICU", 49), (2, 200, "SICU", 49)]


def test_numbering(frame):
    _, stays, adms, pats = world(frame)
    numbered = cohort.number_admissions(adms, pats)
    assert rows(numbered.filter("subject_id = 1"), "admission_id", "admission_num") == [(10, 1), (11, 2)]
    got = rows(cohort.number_stays(stays, numbered).filter("subject_id = 1"), "stay_id", "stay_num", "first_in_time")
    assert got == [(100, 1, h(0)), (101, 2, h(0))]


def test_segments_group_by_nullable_flag(frame):
    moves, stays, adms, pats = world(frame)
    anchor = cohort.first_stays(moves, stays, adms, pats)
    got = rows(cohort.unit_segments(moves, anchor).filter("stay_id = 100"), "unit", "same_unit", "los_min")
    # the last move has no next one and another unit before: unknown flag
    assert got == [("MICU", None, 1200.0), ("MICU", True, 600.0), ("SICU", True, 480.0)]


def test_primary_unit_needs_first_unit_to_dominate(frame):
    moves, stays, adms, pats = world(frame)
    anchor = cohort.first_stays(moves, stays, adms, pats)
    segments = cohort.unit_segments(moves, anchor)
    assert rows(cohort.order_unit_visits(segments, anchor), "subject_id", "unit", "visit_order") == [
        (1, "MICU", 1),
        (1, "SICU", 2),
        (2, "CCU", 1),
        (2, "SICU", 2),
    ]
    primary = cohort.primary_unit(segments, anchor)
    assert rows(primary, "subject_id", "unit", "max_los") == [(1, "MICU", 1800.0)]


def test_profile_and_system(frame):
    moves, stays, adms, pats = world(frame)
    anchor = cohort.first_stays(moves, stays, adms, pats)
    primary = cohort.primary_unit(cohort.unit_segments(moves, anchor), anchor)
    severity = frame([(100, 33)], "stay_id long, severity int")
    profile = cohort.subject_profile(primary, adms, severity)
    assert rows(profile, "subject_id", "min_to_end", "min_to_death", "severity") == [(1, 99 * 60.0, None, 33)]
    assert rows(cohort.subject_system(stays, anchor)) == [(1, "carevue"), (2, "metavision")]
    items = frame([("a", "carevue"), ("b", "metavision"), ("c", None)], "item_id string, system string")
    events = frame([(100, "a"), (100, "c"), (200, "a"), (200, "a")], "stay_id long, item_id string")
    assert rows(cohort.mixed_system_subjects(events, items, stays, anchor)) == [(2,)]
