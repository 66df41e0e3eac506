"""Cohort selection: first stays, unit by dwell, unit visits, profiles.

Canonical columns: ``subject_id, admission_id, stay_id, in_time, out_time,
unit, prev_unit, los`` (hours).  Top-1 picks are ``min(struct)`` aggregates,
which combine map-side, instead of windows over whole groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timing import (
    calendar_age,
    minutes_from_hours,
    plus_days,
    rounded_minutes,
    whole_minutes,
)
from .ranking import next_value, number_rows, time_chunk

# The five care units.
CARE_UNITS = ("CCU", "CSRU", "MICU", "SICU", "TSICU")
DAY_MINUTES = 24 * 60


def early_dwells(transfers: DataFrame, stays: DataFrame, days: int = 1) -> DataFrame:
    """Minutes per transfer, cut at the end of the first ``days`` of the stay.

    Transfers starting later than that are left out; there is no lower bound.
    """
    anchor = stays.select("stay_id", F.col("in_time").alias("stay_in"))
    joined = transfers.join(anchor, "stay_id").filter(
        whole_minutes("in_time", "stay_in") <= days * DAY_MINUTES
    )
    capped = F.least("out_time", plus_days("stay_in", days))
    return joined.select(
        "subject_id",
        "admission_id",
        "stay_id",
        "unit",
        "in_time",
        whole_minutes(capped, "in_time").alias("dwell"),
    )


def dominant_unit(
    transfers: DataFrame, stays: DataFrame, days: int = 1, by: str = "longest"
) -> DataFrame:
    """One row per stay: its unit in the first ``days`` and the time there.

    ``longest`` takes the unit of the longest single transfer (a null dwell
    ranks first), ``sum`` the unit with most time in total.  ``time_spent``
    is the unit's total either way.
    """
    if by not in ("longest", "sum"):
        raise ValueError("by must be 'longest' or 'sum'")
    per_unit = (
        early_dwells(transfers, stays, days)
        .groupBy("subject_id", "admission_id", "stay_id", "unit")
        .agg(
            F.sum("dwell").alias("time_spent"),
            F.min(F.struct((-F.col("dwell")).alias("d"), F.col("in_time").alias("t"))).alias(
                "best"
            ),
        )
    )
    order = {"longest": F.col("best"), "sum": -F.col("time_spent")}[by]
    return (
        per_unit.groupBy("subject_id", "admission_id", "stay_id")
        .agg(F.min(F.struct(order.alias("o"), "unit", "time_spent")).alias("top"))
        .select("subject_id", "admission_id", "stay_id", "top.unit", "top.time_spent")
    )


def documented_admissions(admissions: DataFrame) -> DataFrame:
    return admissions.filter(
        (F.col("has_ioevents_data") == 1) & (F.col("has_chartevents_data") == 1)
    )


def number_admissions(admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """Documented admissions with patient columns, first time and order."""
    joined = documented_admissions(admissions).join(patients, "subject_id")
    first = joined.groupBy("subject_id").agg(F.min("admit_time").alias("first_admit_time"))
    numbered = number_rows(
        time_chunk(joined, "admit_time"),
        ["subject_id"],
        [F.col("admit_time"), F.col("admission_id")],
        "admission_num",
    )
    return numbered.join(first, "subject_id")


def with_stay_times(stays: DataFrame, admissions: DataFrame) -> DataFrame:
    """Stays of the given admissions with age and truncated minutes."""
    a = admissions.drop("subject_id")
    return stays.join(a, "admission_id").select(
        *stays.columns,
        *[c for c in a.columns if c != "admission_id"],
        calendar_age("in_time", "dob").alias("age"),
        whole_minutes("disch_time", "in_time").alias("min_in_to_end"),
        whole_minutes("dod", "in_time").alias("min_in_to_death"),
        whole_minutes("out_time", "in_time").alias("min_in_unit"),
    )


def number_stays(stays: DataFrame, numbered_admissions: DataFrame) -> DataFrame:
    """All stays of documented admissions with order and first entry."""
    timed = with_stay_times(stays, numbered_admissions)
    first = timed.groupBy("admission_id").agg(F.min("in_time").alias("first_in_time"))
    numbered = number_rows(
        time_chunk(timed, "in_time"),
        ["subject_id", "admission_id"],
        [F.col("in_time"), F.col("stay_id")],
        "stay_num",
    )
    return numbered.join(first, "admission_id")


def _first_row(columns: list[str], time: str, tie: str) -> Column:
    """Struct of ``columns`` for the earliest row; unknown times come last."""
    rest = [c for c in columns if c not in (time, tie)]
    return F.min(F.struct(F.col(time).isNull().alias("_unknown"), time, tie, *rest))


def first_stays(
    transfers: DataFrame,
    stays: DataFrame,
    admissions: DataFrame,
    patients: DataFrame,
    min_age: int = 18,
    min_minutes: int = DAY_MINUTES,
    by: str = "longest",
) -> DataFrame:
    """Adult subjects' first stay of their first documented admission.

    Kept when the stay and survival exceed ``min_minutes`` and the stay has
    an early unit (as ``early_unit``).
    """
    a_cols = [c for c in admissions.columns if c != "subject_id"]
    first_admission = (
        documented_admissions(admissions)
        .join(patients.select("subject_id"), "subject_id", "left_semi")
        .groupBy("subject_id")
        .agg(_first_row(a_cols, "admit_time", "admission_id").alias("a"))
        .select("subject_id", *[F.col(f"a.{c}").alias(c) for c in a_cols])
    )
    s_cols = [c for c in stays.columns if c not in ("subject_id", "admission_id")]
    first_stay = (
        stays.join(first_admission.select("admission_id"), "admission_id", "left_semi")
        .groupBy("subject_id", "admission_id")
        .agg(_first_row(s_cols, "in_time", "stay_id").alias("s"))
        .select("subject_id", "admission_id", *[F.col(f"s.{c}").alias(c) for c in s_cols])
    )
    timed = with_stay_times(first_stay, first_admission.join(patients, "subject_id"))
    eligible = timed.filter(
        (F.col("age") >= min_age)
        & (F.col("min_in_unit") > min_minutes)
        & ((F.col("min_in_to_death") > min_minutes) | F.col("dod").isNull())
    )
    units = dominant_unit(transfers, eligible, by=by).select(
        "stay_id", F.col("unit").alias("early_unit")
    )
    return eligible.join(units, "stay_id")


def unit_segments(
    transfers: DataFrame, anchor: DataFrame, units: tuple[str, ...] = CARE_UNITS
) -> DataFrame:
    """Transfers of the anchor stay merged by unit and a nullable flag.

    The flag says the next transfer starts when this one ends, or the unit
    did not change; it is null when neither is known to hold.  Rows without a
    stay never reach the result, so they are dropped before the ordering.
    """
    a = anchor.select(
        "stay_id", F.col("admission_id").alias("_adm"), F.col("in_time").alias("stay_in")
    )
    rows = (
        transfers.filter(F.col("unit").isin(*units))
        .join(a, "stay_id")
        .filter(F.col("admission_id") == F.col("_adm"))
    )
    led = next_value(
        time_chunk(rows, "in_time", "day"),
        ["subject_id", "admission_id", "stay_id"],
        "in_time",
        "next_in",
    )
    same = (F.col("next_in") == F.col("out_time")) | (F.col("prev_unit") == F.col("unit"))
    merged = (
        led.withColumn("same_unit", same)
        .groupBy("subject_id", "admission_id", "stay_id", "unit", "same_unit")
        .agg(
            F.min("in_time").alias("in_time"),
            F.max("out_time").alias("out_time"),
            F.sum(minutes_from_hours("los")).alias("los_min"),
            F.min("stay_in").alias("stay_in"),
        )
    )
    return merged.select(
        "subject_id",
        "admission_id",
        "stay_id",
        "unit",
        "same_unit",
        "in_time",
        "out_time",
        "los_min",
        whole_minutes("in_time", "stay_in").alias("min_in_to_transfer_in"),
        whole_minutes("out_time", "stay_in").alias("min_in_to_transfer_out"),
    )


def unit_visits(segments: DataFrame) -> DataFrame:
    """Earliest entry, latest exit and total time per stay and unit."""
    return segments.groupBy("subject_id", "admission_id", "stay_id", "unit").agg(
        F.min("in_time").alias("earliest_in"),
        F.max("out_time").alias("latest_out"),
        F.sum("los_min").alias("total_los"),
    )


def order_unit_visits(segments: DataFrame, anchor: DataFrame) -> DataFrame:
    """Unit visits numbered per subject by entry, with the early unit."""
    visits = unit_visits(segments).join(anchor.select("stay_id", "early_unit"), "stay_id")
    return number_rows(
        time_chunk(visits, "earliest_in", "day"),
        ["subject_id"],
        [F.col("earliest_in"), F.col("unit")],
        "visit_order",
    )


def primary_unit(segments: DataFrame, anchor: DataFrame) -> DataFrame:
    """Subjects whose first visited unit is also their early unit.

    The longest-visit rule looks only at that first visit, so it always
    holds; ``max_los`` is reported.
    """
    first = (
        unit_visits(segments)
        .groupBy("subject_id")
        .agg(
            F.min(
                F.struct(
                    "earliest_in", "unit", "latest_out", "total_los", "admission_id", "stay_id"
                )
            ).alias("v")
        )
        .select("subject_id", "v.*")
    )
    extra = [c for c in anchor.columns if c not in ("subject_id", "admission_id", "stay_id")]
    return (
        first.filter(F.col("total_los").isNotNull())
        .join(anchor.select("stay_id", *extra), "stay_id")
        .filter(F.col("early_unit") == F.col("unit"))
        .withColumn("max_los", F.col("total_los"))
    )


def subject_profile(
    primary: DataFrame, admissions: DataFrame, severity: DataFrame | None = None
) -> DataFrame:
    """Profile with two-decimal minutes and, when given, the severity score."""
    details = admissions.select(
        "admission_id",
        *[
            c
            for c in ("admission_location", "discharge_location", "insurance", "diagnosis")
            if c in admissions.columns
        ],
    )
    own = [c for c in details.columns if c != "admission_id"]
    profile = (
        primary.drop(*own)
        .join(details, "admission_id")
        .withColumn("min_to_end", rounded_minutes("disch_time", "in_time"))
        .withColumn("min_to_unit_out", rounded_minutes("latest_out", "in_time"))
        .withColumn("min_to_death", rounded_minutes("dod", "in_time"))
        .withColumn("min_unit_out_to_death", rounded_minutes("dod", "latest_out"))
        .withColumn("min_end_to_death", rounded_minutes("dod", "disch_time"))
    )
    return profile.join(severity, "stay_id") if severity is not None else profile


def subject_system(stays: DataFrame, anchor: DataFrame) -> DataFrame:
    """Source system of each subject's anchor stay."""
    return stays.select("subject_id", "stay_id", "system").join(
        anchor.select("stay_id"), "stay_id"
    ).select("subject_id", "system")


def mixed_system_subjects(
    events: DataFrame, items: DataFrame, stays: DataFrame, anchor: DataFrame
) -> DataFrame:
    """Subjects with an event whose item belongs to the other system."""
    pairs = events.select("stay_id", "item_id").distinct()
    return (
        pairs.join(items.select("item_id", F.col("system").alias("item_system")), "item_id")
        .join(stays.select("stay_id", "system"), "stay_id")
        .filter(F.col("system") != F.col("item_system"))
        .join(anchor.select("stay_id", "subject_id"), "stay_id")
        .select("subject_id")
        .distinct()
    )
