from datetime import datetime as dt, timedelta

from anchorage.operators import extract
from anchorage.plans.study import build_study
from anchorage.sources import warehouse
from helpers import rows

T0 = dt(2100, 1, 1, 6)


def h(hours):
    return T0 + timedelta(hours=hours)


def test_warehouse_to_bags(spark, tmp_path):
    """Two subjects through all tables, read back from parquet."""
    data = {
        "transfers": [
            (1, 10, 100, h(0), h(50), 50.0, "admit", None, "MICU", 0, 1),
            (2, 20, 200, h(0), h(30), 30.0, "admit", None, "CCU", 0, 1),
        ],
        "icustays": [(1, 10, 100, h(0), h(50), "carevue"), (2, 20, 200, h(0), h(30), "metavision")],
        "patients": [(1, "F", dt(2050, 1, 1), None), (2, "M", dt(2050, 1, 1), h(40))],
        "admissions": [
            (1, 10, h(-2), h(60), "E", "ER", "HOME", "x", "y", 1, 1),
            (2, 20, h(-2), h(40), "E", "ER", "DEAD", "x", "y", 1, 1),
        ],
        "sapsii": [(100, 20), (200, 50)],
        "chartevents": [
            (1, 10, 100, 7, h(1), "Alert 3"),
            (1, 10, None, 7, h(2), "4.5"),
            (2, 20, 200, 7, h(1), None),
            (2, 20, 200, 8, h(25), "late"),
        ],
        "inputevents_mv": [(2, 20, None, 31, h(3))],
        "inputevents_cv": [(1, None, None, 32, h(3))],
        "outputevents": [(1, 10, 100, 33, h(3))],
        "labevents": [(1, None, 41, h(4)), (1, 10, 41, h(4)), (1, 10, 41, h(4))],
        "microbiologyevents": [
            (1, 10, 5, None, None, None, dt(2100, 1, 1), "s", None, None),
            (2, None, 5, 6, None, h(5), dt(2100, 1, 1), "s", "o", None),
        ],
        "prescriptions": [
            (2, 20, 200, dt(2100, 1, 1), dt(2100, 1, 1), "MAIN", "asa", "asa", '"Aspirin"', "PO"),
            (1, 10, None, dt(2100, 1, 1), None, "MAIN", "nacl", "nacl", "", "IV"),
        ],
        "d_items": [
            (7, "Mental Status", "carevue", "chartevents"),
            (8, "Note", "metavision", "chartevents"),
        ],
        "d_labitems": [(41, "Sodium", "Blood", "Chemistry")],
    }
    for name, table in data.items():
        spark.createDataFrame(table, warehouse.SCHEMAS[name]).write.parquet(str(tmp_path / name))
    out = build_study(warehouse.read_warehouse(spark, str(tmp_path)))
    assert rows(out["profile"], "subject_id", "unit", "min_to_end", "min_to_death", "severity") == [
        (1, "MICU", 3600.0, None, 20),
        (2, "CCU", 2400.0, 2400.0, 50),
    ]
    assert rows(out["systems"]) == [(1, "carevue"), (2, "metavision")]
    assert rows(out["mixed_subjects"]) == [(2,)]
    assert rows(out["value_labels"], "item_id", "label") == [
        ("7_1", "Mental Status alert "),
        ("8_1", "Note late"),
    ]
    # equal moments collapse, drug ends vanish, plain numbers keep the item
    assert rows(out["bags"], "subject_id", "item_id", "cnt", "unit") == [
        (1, "32", 1, "MICU"),
        (1, "33", 1, "MICU"),
        (1, "41", 1, "MICU"),
        (1, "5,,", 1, "MICU"),
        (1, "7", 1, "MICU"),
        (1, "7_1", 1, "MICU"),
        (1, "nacl,IV,start", 1, "MICU"),
        (2, "31", 1, "CCU"),
        (2, "5,6,", 1, "CCU"),
        (2, "7", 1, "CCU"),
        (2, "Aspirin,PO,start", 1, "CCU"),
    ]


def test_harmonised_extracts(frame):
    chart = frame([(1, 7, "7_1", 5.0, 3)], "subject_id long, itemid long, itemid_ind string, min_icuin_to_chart double, hour_of_day int")
    drug = frame([(1, 0, "a,b,start")], "subject_id long, days_from_icuin int, id string")
    mv = frame([(2, 9, 1.0)], "subject_id long, itemid long, min_icuin_to_start double")
    united = extract.unite_events(map(extract.harmonise_extract, (chart, drug, mv)))
    assert rows(united) == [(1, "7_1", 5.0, None), (1, "a,b,start", None, 0), (2, "9", 1.0, None)]
