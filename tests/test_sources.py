from datetime import datetime as dt

import pytest

from anchorage.operators import extract
from anchorage.sources import annotations, files, results, warehouse
from helpers import rows

XML = """<?xml version="1.0" encoding="UTF-8"?>
<CAS version="2">
  <uima.cas.Sofa _id="1" sofaNum="1" sofaString="Chronic heart failure"/>
  <org.apache.ctakes.typesystem.type.textsem.DiseaseDisorderMention _id="10" _ref_ontologyConceptArr="20" begin="0" end="21"/>
  <org.apache.ctakes.typesystem.type.textsem.AnatomicalSiteMention _id="11" _ref_ontologyConceptArr="21" begin="8" end="13"/>
  <org.apache.ctakes.typesystem.type.textsem.EntityMention _id="12" begin="1" end="2"/>
  <uima.cas.FSArray _id="20" size="2"><i>30</i><i>31</i></uima.cas.FSArray>
  <uima.cas.FSArray _id="21" size="1"><i>32</i></uima.cas.FSArray>
  <org.apache.ctakes.typesystem.type.refsem.UmlsConcept _id="30" cui="C001" tui="T047"/>
  <org.apache.ctakes.typesystem.type.refsem.UmlsConcept _id="31" cui="C001" tui="T046"/>
  <org.apache.ctakes.typesystem.type.refsem.UmlsConcept _id="32" cui="C002" tui="T023"/>
</CAS>
"""


def test_annotation_xml(spark, tmp_path):
    (tmp_path / "item1.xml").write_text(XML)
    (tmp_path / "empty.xml").write_text('<?xml version="1.0"?><CAS version="2"></CAS>')
    (tmp_path / ".hidden.xml").write_text("not xml")
    docs = annotations.read_documents(spark, str(tmp_path))
    assert rows(docs, "doc_id") == [("empty",), ("item1",)]
    assert rows(annotations.concept_spans(docs)) == [("item1", "C001", 0, 21), ("item1", "C002", 8, 13)]


@pytest.mark.parametrize("lost", [' begin="0"', ' end="21"'])
def test_annotation_without_an_offset_is_left_out(spark, frame, lost):
    docs = frame([("item1", XML.replace(lost, "", 1))], "doc_id string, xml string")
    assert rows(annotations.concept_spans(docs)) == [("item1", "C002", 8, 13)]


def test_delimited_round_trip(spark, tmp_path, frame):
    df = frame([(1, 'say "hi"; ok'), (2, None), (3, "a,b")], "id long, label string")
    path = str(tmp_path / "t.csv")
    files.write_delimited(df, path)
    assert rows(files.read_delimited(spark, path, "id long, label string")) == rows(df)


def test_word_lists(spark, tmp_path, frame):
    files.write_words(frame([("b",), ("a",)], "word string"), str(tmp_path / "w"))
    assert rows(files.read_words(spark, str(tmp_path / "w"))) == [("a",), ("b",)]
    (tmp_path / "p.rrf").write_text("1|x|Aspirin|\n2|y|Saline|\n")
    assert rows(files.read_column(spark, str(tmp_path / "p.rrf"), "|", 2)) == [("Aspirin",), ("Saline",)]
    (tmp_path / "p.tsv").write_text("1\tname\n")
    assert rows(files.read_column(spark, str(tmp_path / "p.tsv"), "\t", 1)) == [("name",)]


def test_partitioned_tables_prune(spark, tmp_path, frame):
    df = frame([(1, "a", "CCU"), (2, "b", "MICU")], "subject_id long, item_id string, unit string")
    path = str(tmp_path / "bags")
    files.write_partitioned(df, path, ["unit"])
    ccu = files.read_partition(spark, path, unit="CCU")
    assert rows(ccu, "subject_id") == [(1,)]
    plan = ccu._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(unit" in plan


def test_window_extracts(spark, tmp_path, frame):
    anchor = frame([(1, 10, 100, dt(2100, 1, 1))], "subject_id long, admission_id long, stay_id long, anchor_time timestamp_ntz")
    lab = frame([(1, 10, 7, dt(2100, 1, 1, 1))], "subject_id long, admission_id long, itemid long, charttime timestamp_ntz")
    found = extract.extract_all({"lab": lab}, anchor)
    path = str(tmp_path / "events")
    files.write_window(found, path, 0, 1)
    assert rows(files.read_partition(spark, path, source="lab", window="0to24hrs"), "item_id") == [("7",)]


def test_load_or_make_makes_once(spark, tmp_path, frame):
    calls = []

    def make():
        calls.append(1)
        return frame([(1,)], "x long")

    path = str(tmp_path / "split")
    first = rows(files.load_or_make(spark, path, make))
    assert first == rows(files.load_or_make(spark, path, make)) == [(1,)] and len(calls) == 1


def test_warehouse_tables(spark, tmp_path, frame):
    df = frame([(5, "Heart Rate", "carevue", "chartevents")], warehouse.SCHEMAS["d_items"])
    df.write.parquet(str(tmp_path / "d_items"))
    read = warehouse.read_table(spark, str(tmp_path), "d_items")
    assert rows(read, "item_id", "system") == [("5", "carevue")]
    assert set(warehouse.EVENT_TABLES) == set(extract.SOURCES)
    assert set(warehouse.EVENT_TABLES.values()) <= set(warehouse.SCHEMAS)


def test_results(spark, tmp_path, frame):
    results.save_results({"metrics": frame([(0.5,)], "auc double")}, str(tmp_path / "r"), "run1")
    assert rows(results.load_results(spark, str(tmp_path / "r"), "metrics", "run1"), "auc") == [(0.5,)]


def test_stage_dir_needs_a_shared_folder(spark):
    from anchorage.session import stage_dir

    assert stage_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
