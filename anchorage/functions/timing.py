"""Elapsed-time columns.

Two notions of minutes are kept apart: whole minutes truncated toward zero
(cohort rules) and minutes rounded to two decimals (profiles and events).
All take zone-less timestamps and subtract them directly, so no session time
zone or daylight-saving rule takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_minutes(later: Column | str, earlier: Column | str) -> Column:
    return (_col(later) - _col(earlier)).cast("interval minute").cast("bigint")


def rounded_minutes(later: Column | str, earlier: Column | str) -> Column:
    seconds = (_col(later) - _col(earlier)).cast("interval second").cast("decimal(20,6)")
    return F.round(seconds / 60, 2).cast("double")


def midnight(ts: Column | str) -> Column:
    return F.to_date(_col(ts)).cast("timestamp_ntz")


def whole_days_from_midnight(later: Column | str, anchor: Column | str) -> Column:
    """Whole days, truncated toward zero, since the anchor's midnight."""
    return (_col(later) - midnight(anchor)).cast("interval day").cast("int")


def plus_days(ts: Column | str, days: int) -> Column:
    return _col(ts) + F.make_dt_interval(F.lit(days))


def calendar_age(at: Column | str, born: Column | str) -> Column:
    """Completed calendar years between two timestamps."""
    at, born = _col(at), _col(born)

    def within_year(t: Column) -> Column:
        return F.struct(
            F.month(t).alias("m"), F.dayofmonth(t).alias("d"), (t - midnight(t)).alias("t")
        )

    not_reached = (within_year(at) < within_year(born)).cast("int")
    return F.year(at) - F.year(born) - not_reached


def hour_of_day(ts: Column | str) -> Column:
    return F.hour(_col(ts))


def minutes_from_hours(hours: Column | str) -> Column:
    return _col(hours) * 60
