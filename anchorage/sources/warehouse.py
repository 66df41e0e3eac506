"""Schemas of the clinical warehouse and their canonical column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Column name and type of each table the pipeline reads.
SCHEMAS = {
    "transfers": "subject_id long, hadm_id long, icustay_id long, intime timestamp_ntz, "
    "outtime timestamp_ntz, los double, eventtype string, prev_careunit string, "
    "curr_careunit string, prev_wardid int, curr_wardid int",
    "icustays": "subject_id long, hadm_id long, icustay_id long, intime timestamp_ntz, "
    "outtime timestamp_ntz, dbsource string",
    "patients": "subject_id long, gender string, dob timestamp_ntz, dod timestamp_ntz",
    "admissions": "subject_id long, hadm_id long, admittime timestamp_ntz, "
    "dischtime timestamp_ntz, admission_type string, admission_location string, "
    "discharge_location string, insurance string, diagnosis string, "
    "has_ioevents_data int, has_chartevents_data int",
    "sapsii": "icustay_id long, sapsii int",
    "chartevents": "subject_id long, hadm_id long, icustay_id long, itemid long, "
    "charttime timestamp_ntz, value string",
    "inputevents_mv": "subject_id long, hadm_id long, icustay_id long, itemid long, "
    "starttime timestamp_ntz",
    "inputevents_cv": "subject_id long, hadm_id long, icustay_id long, itemid long, "
    "charttime timestamp_ntz",
    "outputevents": "subject_id long, hadm_id long, icustay_id long, itemid long, "
    "charttime timestamp_ntz",
    "labevents": "subject_id long, hadm_id long, itemid long, charttime timestamp_ntz",
    "microbiologyevents": "subject_id long, hadm_id long, spec_itemid long, org_itemid long, "
    "ab_itemid long, charttime timestamp_ntz, chartdate timestamp_ntz, spec_type_desc string, "
    "org_name string, ab_name string",
    "prescriptions": "subject_id long, hadm_id long, icustay_id long, startdate timestamp_ntz, "
    "enddate timestamp_ntz, drug_type string, drug string, drug_name_poe string, "
    "drug_name_generic string, route string",
    "d_items": "itemid long, label string, dbsource string, linksto string",
    "d_labitems": "itemid long, label string, fluid string, category string",
}

# Warehouse name -> canonical name.
CANONICAL = {
    "hadm_id": "admission_id",
    "icustay_id": "stay_id",
    "intime": "in_time",
    "outtime": "out_time",
    "admittime": "admit_time",
    "dischtime": "disch_time",
    "curr_careunit": "unit",
    "prev_careunit": "prev_unit",
    "dbsource": "system",
    "sapsii": "severity",
}

# Event source name -> warehouse table.
EVENT_TABLES = {
    "chart": "chartevents",
    "input_mv": "inputevents_mv",
    "input_cv": "inputevents_cv",
    "output": "outputevents",
    "lab": "labevents",
    "microbiology_timed": "microbiologyevents",
    "microbiology_dated": "microbiologyevents",
    "drug": "prescriptions",
}


def canonical(df: DataFrame) -> DataFrame:
    """Rename warehouse columns; dictionary ids become string ``item_id``."""
    renamed = df.withColumnsRenamed({k: v for k, v in CANONICAL.items() if k in df.columns})
    if "itemid" in renamed.columns and "label" in renamed.columns:
        renamed = renamed.withColumn("item_id", F.col("itemid").cast("string")).drop("itemid")
    return renamed


def read_table(
    spark: SparkSession, root: str, name: str, fmt: str = "parquet", **options
) -> DataFrame:
    """Scan one warehouse table under ``root`` with its declared schema."""
    reader = spark.read.schema(SCHEMAS[name]).options(**options)
    return canonical(reader.format(fmt).load(f"{root}/{name}"))


def read_warehouse(spark: SparkSession, root: str, fmt: str = "parquet", **options):
    """All warehouse tables by name, canonical columns, lazily."""
    return {name: read_table(spark, root, name, fmt, **options) for name in SCHEMAS}
