"""Outcome labels and eligibility relative to information time and gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import interpolated_percentile

EVENT_BEFORE_END = "inhosp"
LONG_STAY = "prolonged_los"
# Minutes of information used and prediction gaps.
INFO_MINUTES = 24 * 60
GAPS = (0, 720, 1440, 2160, 2880)


def _check(outcome: str) -> None:
    if outcome not in (EVENT_BEFORE_END, LONG_STAY):
        raise ValueError(f"outcome must be {EVENT_BEFORE_END!r} or {LONG_STAY!r}")


def stay_cutoff(profile: DataFrame) -> Column:
    """75th percentile of stay length over all subjects, as a scalar."""
    return interpolated_percentile(profile, "min_to_end", 0.75).scalar()


def label_outcome(profile: DataFrame, outcome: str, cutoff: Column | None = None) -> DataFrame:
    """Add ``label``: +1 with the outcome, -1 without; unknown counts as -1."""
    _check(outcome)
    if outcome == EVENT_BEFORE_END:
        positive = F.col("min_to_death") <= F.col("min_to_end")
    else:
        positive = F.col("min_to_end") > (stay_cutoff(profile) if cutoff is None else cutoff)
    return profile.withColumn("label", F.when(F.coalesce(positive, F.lit(False)), 1).otherwise(-1))


def eligible_subjects(
    profile: DataFrame,
    outcome: str,
    gaps: Sequence[float] = (0,),
    info: float = INFO_MINUTES,
    cutoff: Column | None = None,
) -> DataFrame:
    """(subject_id, gap) pairs still at risk at information time + gap.

    A subject leaves when death or end is known to fall by then; for the
    long-stay outcome also when death falls by the stay cutoff, which is taken
    over the whole profile.  All gaps come from one pass.
    """
    _check(outcome)
    at = F.lit(float(info)) + F.col("gap")
    reasons = [F.col("min_to_death") <= at, F.col("min_to_end") <= at]
    if outcome == LONG_STAY:
        reasons.append(F.col("min_to_death") <= F.col("_cutoff"))
    # an unknown time is no reason to leave
    known = [F.coalesce(r, F.lit(False)) for r in reasons]
    drop = known[0]
    for r in known[1:]:
        drop = drop | r
    rows = profile
    if outcome == LONG_STAY:
        rows = rows.withColumn("_cutoff", stay_cutoff(profile) if cutoff is None else cutoff)
    return (
        rows.withColumn("gap", F.explode(F.array(*[F.lit(float(g)) for g in gaps])))
        .filter(~drop)
        .select("subject_id", "gap")
    )


def population(
    profile: DataFrame,
    outcome: str,
    subjects: DataFrame,
    units: Sequence[str] | None = None,
    cutoff: Column | None = None,
) -> DataFrame:
    """Subjects of the chosen units with label, unit and severity."""
    labelled = label_outcome(profile, outcome, cutoff)
    if units is not None:
        labelled = labelled.filter(F.col("unit").isin(*units))
    return labelled.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi").select(
        "subject_id", "unit", "severity", "label"
    )


def cohort_counts(subjects: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cohort size and positives per group."""
    return subjects.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n_positive")
    )
