"""Cohort queries: dwell, encounters, unit visits, profiles, source checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.timing import calendar_age, rounded_minutes, whole_minutes
from ..operators import cohort, items
from ..operators.extract import generic_names
from ..session import stage
from . import roles
from .roles import (
    EVENT_UNITS,
    Tables,
    sql_rounded_minutes,
    sql_whole_minutes,
    with_roles,
)

MIN_AGE = 28


def dwell_unit_rank(t: Tables) -> DataFrame:
    moves = roles.transfers(t)
    return cohort.dominant_unit(moves, roles.stays(t, moves))


def dwell_unit_total(t: Tables) -> DataFrame:
    moves = roles.transfers(t)
    return cohort.dominant_unit(moves, roles.stays(t, moves), by="sum")


def encounter_numbering(t: Tables) -> DataFrame:
    return cohort.number_admissions(roles.admissions(t), roles.patients(t)).select(
        "subject_id", "admission_id", "admit_time", "first_admit_time", "admission_num"
    )


def encounter_stays(t: Tables) -> DataFrame:
    moves = stage(roles.transfers(t), "transfers")
    numbered = cohort.number_admissions(roles.admissions(t, moves), roles.patients(t))
    return cohort.number_stays(roles.stays(t, moves), numbered).select(
        "subject_id",
        "admission_id",
        "stay_id",
        "first_in_time",
        "stay_num",
        "admission_num",
        "age",
        "min_in_to_end",
        "min_in_to_death",
        "min_in_unit",
    )


def _anchor(t: Tables, moves: DataFrame) -> DataFrame:
    return cohort.first_stays(
        moves, roles.stays(t, moves), roles.admissions(t, moves), roles.patients(t), min_age=MIN_AGE
    )


def first_stay_cohort(t: Tables) -> DataFrame:
    moves = stage(roles.transfers(t), "transfers")
    return _anchor(t, moves).select(
        "subject_id", "admission_id", "stay_id", "age", "min_in_unit", "early_unit"
    )


def _segments(t: Tables) -> tuple[DataFrame, DataFrame]:
    moves = stage(roles.transfers(t), "transfers")
    anchor = stage(_anchor(t, moves), "anchor")
    return cohort.unit_segments(moves, anchor, EVENT_UNITS), anchor


def transfer_segments(t: Tables) -> DataFrame:
    segments, _ = _segments(t)
    return segments.withColumn("los_min", F.round("los_min", 4))


def unit_visit_order(t: Tables) -> DataFrame:
    segments, anchor = _segments(t)
    return cohort.order_unit_visits(segments, anchor).select(
        "subject_id",
        "stay_id",
        "unit",
        "earliest_in",
        "latest_out",
        F.round("total_los", 4).alias("total_los"),
        "early_unit",
        "visit_order",
    )


def primary_unit(t: Tables) -> DataFrame:
    segments, anchor = _segments(t)
    return cohort.primary_unit(segments, anchor).select(
        "subject_id", "stay_id", "unit", "age", F.round("max_los", 4).alias("max_los")
    )


def subject_profile(t: Tables) -> DataFrame:
    moves = stage(roles.transfers(t), "transfers")
    anchor = stage(_anchor(t, moves), "anchor")
    primary = cohort.primary_unit(cohort.unit_segments(moves, anchor, EVENT_UNITS), anchor)
    profile = cohort.subject_profile(primary, roles.admissions(t, moves), roles.severity(t))
    return profile.select(
        "subject_id",
        "unit",
        "admission_location",
        "discharge_location",
        "min_to_end",
        "min_to_unit_out",
        "min_to_death",
        "min_unit_out_to_death",
        "min_end_to_death",
        "severity",
    )


def subject_profile_times(t: Tables) -> DataFrame:
    """Elapsed-time functions over all line items and their orders."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        rounded_minutes("l_shipdate", "o_orderdate").alias("minutes"),
        whole_minutes("l_shipdate", "o_orderdate").alias("whole_minutes"),
        calendar_age("l_shipdate", "o_orderdate").alias("years"),
    )


def _chart_and_items(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = roles.event_rows(t)
    events = rows.select("stay_id", F.col("event_type").alias("item_id"))
    system = F.when(F.col("event_type").isin("click", "error"), "carevue").otherwise("metavision")
    dictionary = rows.select(F.col("event_type").alias("item_id"), system.alias("system")).distinct()
    return events, dictionary


def source_mismatch_subjects(t: Tables) -> DataFrame:
    moves = stage(roles.transfers(t), "transfers")
    events, dictionary = _chart_and_items(t)
    return cohort.mixed_system_subjects(
        events, dictionary, roles.stays(t, moves), _anchor(t, moves)
    )


def subject_source(t: Tables) -> DataFrame:
    moves = stage(roles.transfers(t), "transfers")
    return cohort.subject_system(roles.stays(t, moves), _anchor(t, moves))


def _prescriptions(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.part, F.col("l_partkey") == F.col("p_partkey")
    )
    generic = F.when(F.col("p_size") > 40, None).when(F.col("p_size") > 25, "").otherwise(F.col("p_type"))
    return lines.select(
        F.col("o_custkey").alias("subject_id"),
        F.col("l_shipdate").alias("startdate"),
        F.col("p_name").alias("drug"),
        generic.alias("drug_name_generic"),
        F.col("l_returnflag").alias("route"),
    )


def fallback_name_union(t: Tables) -> DataFrame:
    return generic_names(_prescriptions(t))


def item_dictionaries(t: Tables) -> DataFrame:
    """Drug and microbiology dictionaries in one table."""
    drugs = items.drug_dictionary(generic_names(_prescriptions(t))).select(
        F.lit("drug").alias("family"),
        F.concat_ws(",", "drug_name", "route", "start").alias("item_id"),
        F.col("drug_name").alias("label"),
    )
    rows = roles.event_sources(t)["microbiology_timed"]
    labelled = rows.select(
        "*",
        F.concat(F.lit("s"), "spec_itemid").alias("spec_type_desc"),
        F.concat(F.lit("o"), "org_itemid").alias("org_name"),
        F.concat(F.lit("a"), "ab_itemid").alias("ab_name"),
    )
    micro = items.microbiology_dictionary(labelled).select(
        F.lit("microbiology").alias("family"), "item_id", "label"
    )
    return drugs.unionByName(micro)


QUERIES = {
    "dwell_unit_rank": dwell_unit_rank,
    "dwell_unit_total": dwell_unit_total,
    "encounter_numbering": encounter_numbering,
    "encounter_stays": encounter_stays,
    "first_stay_cohort": first_stay_cohort,
    "transfer_segments": transfer_segments,
    "unit_visit_order": unit_visit_order,
    "primary_unit": primary_unit,
    "subject_profile": subject_profile,
    "subject_profile_times": subject_profile_times,
    "source_mismatch_subjects": source_mismatch_subjects,
    "subject_source": subject_source,
    "fallback_name_union": fallback_name_union,
    "item_dictionaries": item_dictionaries,
}

# --- SQL ---------------------------------------------------------------------

_DWELLS = f"""SELECT t.subject_id, t.admission_id, t.stay_id, t.unit, t.in_time,
    {sql_whole_minutes("least(t.out_time, s.in_time + INTERVAL 1 DAY)", "t.in_time")} AS dwell
    FROM transfers t JOIN stays s USING (stay_id)
    WHERE {sql_whole_minutes("t.in_time", "s.in_time")} <= 1440"""
_DOMINANT = """SELECT * EXCLUDE (rn) FROM
    (SELECT subject_id, admission_id, stay_id, unit,
            CAST(sum(dwell) OVER (PARTITION BY stay_id, unit) AS BIGINT) AS time_spent,
            row_number() OVER (PARTITION BY stay_id
              ORDER BY dwell DESC NULLS FIRST, in_time, unit) AS rn FROM dwells) WHERE rn = 1"""
_NUMBERED = """SELECT a.*, p.dod, p.dob,
    min(admit_time) OVER (PARTITION BY a.subject_id) AS first_admit_time,
    row_number() OVER (PARTITION BY a.subject_id ORDER BY admit_time, admission_id) AS admission_num
    FROM admissions a JOIN patients p ON a.subject_id = p.subject_id
    WHERE has_ioevents_data = 1 AND has_chartevents_data = 1"""
_STAYS = f"""SELECT s.*, n.dod, n.dob, n.admit_time, n.disch_time, admission_num,
    min(s.in_time) OVER (PARTITION BY s.admission_id) AS first_in_time,
    row_number() OVER (PARTITION BY s.subject_id, s.admission_id ORDER BY s.in_time, s.stay_id)
      AS stay_num,
    CAST(date_part('year', age(s.in_time, n.dob)) AS INTEGER) AS age,
    {sql_whole_minutes('n.disch_time', 's.in_time')} AS min_in_to_end,
    {sql_whole_minutes('n.dod', 's.in_time')} AS min_in_to_death,
    {sql_whole_minutes('s.out_time', 's.in_time')} AS min_in_unit
    FROM stays s JOIN numbered n ON s.admission_id = n.admission_id"""
_COHORT = f"""SELECT s.*, d.unit AS early_unit FROM stay_rows s JOIN dominant d USING (stay_id)
    WHERE age >= {MIN_AGE} AND admission_num = 1 AND stay_num = 1 AND min_in_unit > 1440
      AND (min_in_to_death > 1440 OR dod IS NULL)"""
_SEGMENTS = f"""SELECT m.*, {sql_whole_minutes('m.in_time', 'c.in_time')} AS min_in_to_transfer_in,
    {sql_whole_minutes('m.out_time', 'c.in_time')} AS min_in_to_transfer_out
    FROM (SELECT subject_id, admission_id, stay_id, unit, same_unit, min(in_time) AS in_time,
                 max(out_time) AS out_time, round(sum(los * 60), 4) AS los_min
          FROM (SELECT *, (next_in = out_time OR prev_unit = unit) AS same_unit
                FROM (SELECT t.*, lead(t.in_time) OVER
                        (PARTITION BY t.subject_id, t.admission_id, t.stay_id ORDER BY t.in_time)
                        AS next_in
                      FROM transfers t JOIN cohort c ON t.admission_id = c.admission_id
                      WHERE t.stay_id IS NULL OR t.stay_id = c.stay_id))
          GROUP BY ALL) m JOIN cohort c ON m.stay_id = c.stay_id"""
_VISITS = """SELECT v.subject_id, v.stay_id, v.unit, earliest_in, latest_out,
    round(total_los, 4) AS total_los, early_unit,
    row_number() OVER (PARTITION BY v.subject_id ORDER BY earliest_in, v.unit) AS visit_order
    FROM (SELECT subject_id, admission_id, stay_id, unit, min(in_time) AS earliest_in,
                 max(out_time) AS latest_out, sum(los_min) AS total_los
          FROM segments GROUP BY ALL) v JOIN cohort c ON v.stay_id = c.stay_id"""
_PRIMARY = """SELECT v.subject_id, v.stay_id, v.unit, v.earliest_in, v.latest_out, c.age, c.in_time,
    c.admission_id, c.disch_time, c.dod, v.max_los
    FROM (SELECT *, max(total_los) OVER (PARTITION BY subject_id, stay_id) AS max_los
          FROM visits WHERE visit_order = 1) v JOIN cohort c USING (stay_id)
    WHERE total_los = max_los AND v.early_unit = v.unit"""

_HOSPITAL = ("transfers", "stays", "admissions", "patients")
_STEPS = {
    "dwells": _DWELLS,
    "dominant": _DOMINANT,
    "numbered": _NUMBERED,
    "stay_rows": _STAYS,
    "cohort": _COHORT,
    "segments": _SEGMENTS,
    "visits": _VISITS,
    "primary_rows": _PRIMARY,
}


def _upto(last: str, body: str, roles_: tuple[str, ...] = _HOSPITAL) -> str:
    names = list(_STEPS)
    return with_roles(roles_, body, **{n: _STEPS[n] for n in names[: names.index(last) + 1]})


_PRESCRIPTIONS = """SELECT o_custkey AS subject_id, l_shipdate AS startdate, p_name AS drug,
    CASE WHEN p_size > 40 THEN NULL WHEN p_size > 25 THEN '' ELSE p_type END AS drug_name_generic,
    l_returnflag AS route
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""
_GENERIC = """SELECT subject_id, startdate, drug, route, drug_name_generic AS drug_name
    FROM prescriptions WHERE drug_name_generic <> ''
    UNION SELECT subject_id, startdate, drug, route, drug AS drug_name
    FROM prescriptions WHERE drug_name_generic = ''"""

ORACLES = {
    "dwell_unit_rank": _upto("dominant", "SELECT * FROM dominant", ("transfers", "stays")),
    "dwell_unit_total": _upto(
        "dwells",
        """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
             (PARTITION BY stay_id ORDER BY time_spent DESC NULLS FIRST, unit) AS rn
           FROM (SELECT subject_id, admission_id, stay_id, unit,
                        CAST(sum(dwell) AS BIGINT) AS time_spent FROM dwells GROUP BY ALL))
           WHERE rn = 1""",
        ("transfers", "stays"),
    ),
    "encounter_numbering": with_roles(
        ("admissions", "patients"),
        """SELECT subject_id, admission_id, admit_time, first_admit_time, admission_num
           FROM numbered""",
        numbered=_NUMBERED,
    ),
    "encounter_stays": _upto(
        "stay_rows",
        """SELECT subject_id, admission_id, stay_id, first_in_time, stay_num, admission_num, age,
           min_in_to_end, min_in_to_death, min_in_unit FROM stay_rows""",
    ),
    "first_stay_cohort": _upto(
        "cohort",
        "SELECT subject_id, admission_id, stay_id, age, min_in_unit, early_unit FROM cohort",
    ),
    "transfer_segments": _upto("segments", "SELECT * FROM segments"),
    "unit_visit_order": _upto("visits", "SELECT * FROM visits"),
    "primary_unit": _upto(
        "primary_rows", "SELECT subject_id, stay_id, unit, age, max_los FROM primary_rows"
    ),
    "subject_profile": _upto(
        "primary_rows",
        f"""SELECT p.subject_id, p.unit, admission_location, discharge_location,
            {sql_rounded_minutes('p.disch_time', 'p.in_time')} AS min_to_end,
            {sql_rounded_minutes('p.latest_out', 'p.in_time')} AS min_to_unit_out,
            {sql_rounded_minutes('p.dod', 'p.in_time')} AS min_to_death,
            {sql_rounded_minutes('p.dod', 'p.latest_out')} AS min_unit_out_to_death,
            {sql_rounded_minutes('p.dod', 'p.disch_time')} AS min_end_to_death, s.severity
            FROM primary_rows p JOIN admissions a ON a.admission_id = p.admission_id
            JOIN severity s ON s.stay_id = p.stay_id""",
        (*_HOSPITAL, "severity"),
    ),
    "subject_profile_times": f"""SELECT l_orderkey, l_linenumber, l_partkey,
        {sql_rounded_minutes('l_shipdate', 'o_orderdate')} AS minutes,
        {sql_whole_minutes('l_shipdate', 'o_orderdate')} AS whole_minutes,
        CAST(year(l_shipdate) - year(o_orderdate)
          - CASE WHEN (month(l_shipdate), day(l_shipdate)) < (month(o_orderdate), day(o_orderdate))
                 THEN 1 ELSE 0 END AS INTEGER) AS years
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "source_mismatch_subjects": _upto(
        "cohort",
        """SELECT DISTINCT c.subject_id
           FROM (SELECT DISTINCT stay_id, event_type FROM event_rows) e
           JOIN stays s USING (stay_id) JOIN cohort c USING (stay_id)
           WHERE s.system <> CASE WHEN event_type IN ('click', 'error') THEN 'carevue'
                                  ELSE 'metavision' END""",
    ),
    "subject_source": _upto(
        "cohort",
        "SELECT s.subject_id, s.system FROM stays s JOIN cohort c ON c.stay_id = s.stay_id",
    ),
    "fallback_name_union": with_roles((), "SELECT * FROM g", prescriptions=_PRESCRIPTIONS, g=_GENERIC),
    "item_dictionaries": with_roles(
        ("event_rows",),
        """SELECT DISTINCT 'drug' AS family, drug_name || ',' || route || ',start' AS item_id,
             drug_name AS label FROM g
           UNION ALL
           SELECT DISTINCT 'microbiology',
             k || ',' || coalesce(org, '') || ',' || ab,
             's' || k || ',' || coalesce('o' || org, '') || ','
               || CASE WHEN ab <> '' THEN 'a' || ab ELSE '' END
           FROM (SELECT CAST(k AS VARCHAR) AS k,
                   CASE WHEN event_type <> 'error'
                        THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS org,
                   CASE event_type WHEN 'click' THEN '1' WHEN 'view' THEN '2' ELSE '' END AS ab
                 FROM event_rows)""",
        prescriptions=_PRESCRIPTIONS,
        g=_GENERIC,
    ),
}
