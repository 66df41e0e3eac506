"""Events in a window relative to each subject's anchor time.

A source is described by a ``SourceSpec``; one function serves all.  Keys
cascade: an event is matched on its first non-null key only (stay, else
admission, else subject).  Instead of one join per key, the event gets a
(level, key) pair and the anchor one row per level, so each source is read
once and joined once, on an equality.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import composite_key, trim_char
from ..functions.timing import (
    hour_of_day,
    plus_days,
    rounded_minutes,
    whole_days_from_midnight,
)


@dataclass(frozen=True)
class SourceSpec:
    """How one event table is matched and what it yields.

    ``keys``: cascade order.  ``item``: one column, or several for a
    composite key.  ``dated``: the time column has no time of day, so offsets
    are whole days.  ``phases``: (time column, literal tag) pairs; each is a
    separate event and the tag joins the item key.  ``null_time``: column
    that has to be null for a row to count (dated twin of a timed source).
    """

    name: str
    keys: tuple[str, ...]
    time: str | None
    item: tuple[str, ...]
    dated: bool = False
    value: str | None = None
    trim: bool = False
    phases: tuple[tuple[str, str], ...] = ()
    null_time: str | None = None


# The eight sources of the clinical warehouse.
SOURCES = {
    s.name: s
    for s in (
        SourceSpec("chart", ("stay_id", "admission_id"), "charttime", ("itemid",), value="value"),
        SourceSpec("input_mv", ("stay_id", "admission_id"), "starttime", ("itemid",)),
        SourceSpec("input_cv", ("stay_id", "admission_id", "subject_id"), "charttime", ("itemid",)),
        SourceSpec("output", ("stay_id", "admission_id", "subject_id"), "charttime", ("itemid",)),
        SourceSpec("lab", ("admission_id", "subject_id"), "charttime", ("itemid",)),
        SourceSpec(
            "microbiology_timed",
            ("admission_id", "subject_id"),
            "charttime",
            ("spec_itemid", "org_itemid", "ab_itemid"),
        ),
        SourceSpec(
            "microbiology_dated",
            ("admission_id", "subject_id"),
            "chartdate",
            ("spec_itemid", "org_itemid", "ab_itemid"),
            dated=True,
            null_time="charttime",
        ),
        SourceSpec(
            "drug",
            ("stay_id", "admission_id"),
            None,
            ("drug_name", "route"),
            dated=True,
            trim=True,
            phases=(("startdate", "start"), ("enddate", "end")),
        ),
    )
}


def duplicated_anchor_keys(anchor: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Anchor keys held by more than one row; empty for a valid anchor."""
    long = anchor.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("id"))
                    for k in keys
                ]
            )
        ).alias("k")
    ).select("k.*")
    return (
        long.filter(F.col("id").isNotNull())
        .groupBy("key", "id")
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > 1)
    )


def join_anchor(events: DataFrame, anchor: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Events with the anchor time (``anchor_time``) of their first non-null key."""
    by_level = anchor.select(
        F.posexplode(F.array(*[F.col(k).cast("string") for k in keys])).alias("_level", "_key"),
        "anchor_time",
    ).filter(F.col("_key").isNotNull())
    level = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(i)) for i, k in enumerate(keys)])
    key = F.coalesce(*[F.col(k).cast("string") for k in keys])
    return (
        events.withColumn("_level", level)
        .withColumn("_key", key)
        .join(by_level, ["_level", "_key"])
        .drop("_level", "_key")
    )


def in_window(time: Column | str, lo: int, hi: int) -> Column:
    """``anchor + lo days <= time < anchor + hi days``."""
    time = F.col(time) if isinstance(time, str) else time
    return (time >= plus_days("anchor_time", lo)) & (time < plus_days("anchor_time", hi))


def extract_window(
    events: DataFrame, anchor: DataFrame, spec: SourceSpec, lo: int = 0, hi: int = 1
) -> DataFrame:
    """Canonical events of one source in days ``[lo, hi)`` of the anchor.

    Timed sources give ``min_from_anchor`` (two decimals), ``hour_of_day``
    and, if the spec has one, ``value``; dated sources are matched on day
    ``lo`` and give ``days_from_anchor``.
    """
    if spec.null_time:
        events = events.filter(F.col(spec.null_time).isNull())
    if spec.phases:
        events = events.select(
            "*",
            F.explode(
                F.array(
                    *[
                        F.struct(F.col(c).alias("_time"), F.lit(tag).alias("_phase"))
                        for c, tag in spec.phases
                    ]
                )
            ).alias("_p"),
        ).select("*", "_p._time", "_p._phase")
    else:
        events = events.withColumn("_time", F.col(spec.time))
    events = events.filter(F.col("_time").isNotNull())

    parts = [trim_char(c) if spec.trim else F.col(c) for c in spec.item]
    if spec.phases:
        parts.append(F.col("_phase"))
    item = composite_key(*parts) if len(parts) > 1 else parts[0].cast("string")

    joined = join_anchor(events, anchor, spec.keys)
    if spec.dated:
        days = whole_days_from_midnight("_time", "anchor_time")
        return joined.filter(days == lo).select(
            "subject_id", item.alias("item_id"), days.alias("days_from_anchor")
        )
    columns = [
        F.col("subject_id"),
        item.alias("item_id"),
        rounded_minutes("_time", "anchor_time").alias("min_from_anchor"),
        hour_of_day("_time").alias("hour_of_day"),
    ]
    if spec.value:
        columns.append(F.col(spec.value).cast("string").alias("value"))
    return joined.filter(in_window("_time", lo, hi)).select(*columns)


def extract_all(
    tables: dict[str, DataFrame],
    anchor: DataFrame,
    lo: int = 0,
    hi: int = 1,
    specs: Iterable[SourceSpec] = tuple(SOURCES.values()),
) -> dict[str, DataFrame]:
    """Every source of ``specs`` that has a table, extracted for one window."""
    return {
        s.name: extract_window(tables[s.name], anchor, s, lo, hi)
        for s in specs
        if s.name in tables
    }


# Column names of event extracts -> canonical names.
EXTRACT_NAMES = {
    "itemid": "item_id",
    "id": "item_id",
    "min_icuin_to_chart": "min_from_anchor",
    "min_icuin_to_start": "min_from_anchor",
    "days_from_icuin": "days_from_anchor",
}


def harmonise_extract(extract: DataFrame) -> DataFrame:
    """Event extract of any source with canonical columns.

    Where values were turned into items, ``itemid_ind`` is the item.
    """
    if "itemid_ind" in extract.columns:
        extract = extract.drop("itemid").withColumnRenamed("itemid_ind", "itemid")
    renamed = extract.withColumnsRenamed(
        {old: new for old, new in EXTRACT_NAMES.items() if old in extract.columns}
    ).withColumn("item_id", F.col("item_id").cast("string"))
    wanted = ("subject_id", "item_id", "min_from_anchor", "days_from_anchor")
    return renamed.select(*[c for c in wanted if c in renamed.columns])


def unite_events(frames: Iterable[DataFrame]) -> DataFrame:
    """Distinct (subject, item, offset) rows of timed and dated sources.

    Dropping repeats before counting makes a bag count distinct moments.
    """
    wanted = ("subject_id", "item_id", "min_from_anchor", "days_from_anchor")
    united = None
    for frame in frames:
        part = frame.select(*[c for c in wanted if c in frame.columns])
        united = part if united is None else united.unionByName(part, allowMissingColumns=True)
    if united is None:
        raise ValueError("no event frames given")
    for c, t in (("min_from_anchor", "double"), ("days_from_anchor", "int")):
        if c not in united.columns:
            united = united.withColumn(c, F.lit(None).cast(t))
    return united.select(*wanted).distinct()


def events_before_end(
    events: DataFrame, profile: DataFrame, minutes_per_day_unit: int = 60
) -> DataFrame:
    """Events before the end of the subject's stay.

    Timed events compare minutes.  Dated events compare their day number with
    ``floor(minutes / minutes_per_day_unit)``; the default of 60 keeps the
    established behaviour (days against hours), 1440 compares days with days.
    """
    end = F.col("min_to_end")
    timed = F.coalesce(F.col("min_from_anchor") < end, F.lit(False))
    dated = F.coalesce(
        F.col("days_from_anchor") < F.floor(end / minutes_per_day_unit), F.lit(False)
    )
    return (
        events.join(profile.select("subject_id", "min_to_end"), "subject_id")
        .filter(timed | dated)
        .drop("min_to_end")
    )


def generic_names(prescriptions: DataFrame) -> DataFrame:
    """Drug rows named by generic name, or by drug where that is empty.

    A null generic name is in neither branch; repeated rows collapse.
    """
    kept = prescriptions.drop("drug_name_generic").columns
    generic = F.col("drug_name_generic")
    named = prescriptions.filter(generic.isNotNull()).select(
        *kept, F.when(generic != "", generic).otherwise(F.col("drug")).alias("drug_name")
    )
    return named.distinct()
