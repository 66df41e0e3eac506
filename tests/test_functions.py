from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from anchorage.functions import keys, text, timing
from helpers import rows

PAIR = "a timestamp_ntz, b timestamp_ntz"


def pair(frame, a, b):
    return frame([(a, b)], PAIR)


@pytest.mark.parametrize(
    "a, b, whole, rounded",
    [
        (dt(2020, 1, 2, 2, 1, 59), dt(2020, 1, 1), 1561, 1561.98),
        (dt(2020, 1, 1), dt(2020, 1, 2, 2, 1, 59), -1561, -1561.98),
        (dt(2020, 1, 1, 0, 0, 0, 300000), dt(2020, 1, 1), 0, 0.01),
        (None, dt(2020, 1, 1), None, None),
    ],
)
def test_two_kinds_of_minutes(frame, a, b, whole, rounded):
    df = pair(frame, a, b).select(timing.whole_minutes("a", "b"), timing.rounded_minutes("a", "b"))
    assert tuple(df.first()) == (whole, rounded)


@pytest.mark.parametrize(
    "at, born, years",
    [
        (dt(2018, 2, 28), dt(2000, 2, 29), 17),
        (dt(2018, 3, 1), dt(2000, 2, 29), 18),
        (dt(2018, 5, 5, 11), dt(2000, 5, 5, 12), 17),
        (dt(2018, 5, 5, 12), dt(2000, 5, 5, 12), 18),
    ],
)
def test_calendar_age(frame, at, born, years):
    assert pair(frame, at, born).select(timing.calendar_age("a", "b")).first()[0] == years


def test_days_count_from_midnight(frame):
    df = pair(frame, dt(2020, 1, 2), dt(2020, 1, 1, 23, 59))
    assert df.select(timing.whole_days_from_midnight("a", "b")).first()[0] == 1


def test_least_skips_null_out_time(frame):
    df = pair(frame, None, dt(2020, 1, 1))
    got = df.select(F.least("a", timing.plus_days("b", 1))).first()[0]
    assert got == dt(2020, 1, 2)


def test_composite_key_prints_null_as_empty(frame):
    df = frame([(1, None, "x")], "a long, b long, c string")
    assert df.select(keys.composite_key("a", "b", "c")).first()[0] == "1,,x"


def test_key_cleaning(frame):
    df = frame([('("Drug ""A""",IV,start)',), ("(1,,3)",)], "k string")
    got = rows(df.select(keys.clean_composite_key("k", "all"), keys.phase_of("k")))
    assert got == [("1,,3", "3"), ("Drug A,IV,start", "start")]
    assert df.select(keys.trim_char(F.lit('"x"'))).first()[0] == "x"


def test_document_name(frame):
    df = frame([("file:/a/b/prescription-7.xml",)], "p string")
    assert df.select(keys.document_item_id("p")).first()[0] == "prescription-7"


def test_value_normaliser(frame):
    df = frame([("12.5",), ("Abc",), ("5 mmHg",), ("a, b",), (None,), ("",)], "v string")
    got = [r[0] for r in df.select(text.normalise_value("v")).collect()]
    assert got == [None, "abc", " mmhg", "a  b", None, None]
    squeezed = [r[0] for r in df.select(text.normalise_value("v", squeeze=True)).collect()]
    assert squeezed == [None, "abc", "mmhg", "a b", None, None]


@pytest.mark.parametrize(
    "label, cleaned, any_case",
    [
        ("PO intake", "by mouth intake", "by mouth intake"),
        ("po intake", "po intake", "by mouth intake"),
        ("S/P fall", "status post fall", "status post fall"),
        ("s/p fall", "status post fall", "status post fall"),
        ("(L) arm", " left  arm", " left  arm"),
        ("High PIP", "high peak inspiratory pressure", "high peak inspiratory pressure"),
        ("#1 Neg", "1 negative", "1 negative"),
        ("insp. flow", "inspiratory flow", "inspiratory flow"),
        ("ed note", "ed note", "emergency department note"),
        ("", None, None),
        (None, None, None),
    ],
)
def test_clean_label(frame, label, cleaned, any_case):
    df = frame([(label,)], "l string")
    got = df.select(text.clean_label("l"), text.clean_label("l", ignore_case=True)).first()
    assert tuple(got) == (cleaned, any_case)


def test_description_tokens(frame):
    df = frame([("A b,c;;D",), (None,)], "l string")
    assert [r[0] for r in df.select(text.tokenised_description("l")).collect()] == ["a b c d", "N/A"]
    assert df.select(text.acronyms("l")).first()[0] == ["A"]


@pytest.mark.parametrize("block", [1, 2, 128])
def test_located_words_match_python(frame, block):
    import regex

    samples = ["", "  ", "Hello, wörld! x", "a" * 300 + " b_c 9", "ünïcode—dash\nline two"]
    samples.append(" ".join(f"w{i}" for i in range(700)))
    df = frame([(s,) for s in samples], "t string")
    got = [[tuple(w) for w in r[0]] for r in df.select(text.located_words("t", block)).collect()]
    want = [
        [(m.group(), m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}_]+", s)]
        for s in samples
    ]
    assert got == want
