"""From the warehouse tables to cohort, events and bags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators import bag, cohort, extract, items
from ..session import stage
from ..sources.warehouse import EVENT_TABLES


def build_study(
    tables: dict[str, DataFrame],
    units: Sequence[str] = cohort.CARE_UNITS,
    lo: int = 0,
    hi: int = 1,
) -> dict[str, DataFrame]:
    """Cohort profile, source systems, mixed subjects, events and bags.

    ``tables`` are warehouse tables with canonical columns
    (``sources.warehouse.read_warehouse``).  The profile, used by every event
    source, and the value dictionary are stage tables.
    """
    t = tables
    anchor = stage(
        cohort.first_stays(t["transfers"], t["icustays"], t["admissions"], t["patients"]), "anchor"
    )
    segments = cohort.unit_segments(t["transfers"], anchor, tuple(units))
    primary = cohort.primary_unit(segments, anchor)
    profile = stage(cohort.subject_profile(primary, t["admissions"], t["sapsii"]), "profile")

    chart = t["chartevents"].withColumn("item_id", F.col("itemid").cast("string"))
    known = chart.join(t["d_items"].select("item_id"), "item_id", "left_semi")
    values = stage(items.value_dictionary(known.select("item_id", "value")), "values")

    sources = {s: t[name] for s, name in EVENT_TABLES.items()}
    sources["drug"] = extract.generic_names(t["prescriptions"])
    at = profile.withColumnRenamed("in_time", "anchor_time")
    found = extract.extract_all(sources, at, lo, hi)
    found["chart"] = items.tokenise_values(found["chart"], values)

    events = extract.unite_events(found.values())
    scoped = extract.events_before_end(events, profile)
    return {
        "profile": profile,
        "systems": cohort.subject_system(t["icustays"], profile),
        "mixed_subjects": cohort.mixed_system_subjects(
            chart.select("stay_id", "item_id"), t["d_items"], t["icustays"], profile
        ),
        "value_labels": items.value_labels(values, t["d_items"]),
        "events": events,
        "bags": bag.clean_bag_items(bag.unit_bags(scoped, profile, list(units))),
    }
