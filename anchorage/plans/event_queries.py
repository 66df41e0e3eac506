"""Extraction, bag, outcome and eligibility queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import bag, items, outcome
from ..operators.extract import SOURCES, events_before_end, extract_all, extract_window, unite_events
from . import roles
from .roles import GAPS, INFO, THRESHOLD, UNITS, Tables, sql_days, sql_rounded_minutes, with_roles


def bag_of_events(t: Tables) -> DataFrame:
    """Flagship: anchored window, distinct moments, counts per subject and item."""
    return bag.bag_of_events(unite_events([roles.order_events(t)]))


def window_events_cascade(t: Tables) -> DataFrame:
    return extract_window(
        roles.order_lines(t), roles.order_anchor(t), SOURCES["input_cv"], 0, roles.WINDOW_DAYS
    )


def window_valued_events(t: Tables) -> DataFrame:
    return extract_window(
        roles.event_sources(t)["chart"], roles.event_anchor(t), SOURCES["chart"], 0, 1
    )


def window_events_by_day(t: Tables) -> DataFrame:
    """Dated microbiology rows of the day after the anchor day."""
    return extract_window(
        roles.event_sources(t)["microbiology_dated"],
        roles.event_anchor(t),
        SOURCES["microbiology_dated"],
        1,
        2,
    )


def start_end_events(t: Tables) -> DataFrame:
    return extract_window(
        roles.event_sources(t)["drug"], roles.event_anchor(t), SOURCES["drug"], 1, 2
    )


def _united(t: Tables) -> DataFrame:
    extracted = extract_all(roles.event_sources(t), roles.event_anchor(t), 0, 1)
    return unite_events(extracted.values())


def events_union_dedup(t: Tables) -> DataFrame:
    return _united(t)


def scoped_events(t: Tables) -> DataFrame:
    return events_before_end(_united(t), roles.event_profile(t), 1440)


def source_bags(t: Tables) -> DataFrame:
    """Bags over all eight sources, drug ends dropped and ids tidied."""
    return bag.clean_bag_items(bag.bag_of_events(_united(t)))


def _valued_lines(t: Tables) -> DataFrame:
    """Line items as valued events: numbers, sizes, names or nothing."""
    parts = t.part.select("p_partkey", "p_brand", "p_name", "p_type", "p_size")
    flag = F.col("l_returnflag")
    named = F.concat_ws(" @", "p_name", F.col("l_linenumber").cast("string"))
    sized = F.concat_ws("-", "p_type", F.col("p_size").cast("string"))
    value = (
        F.when(flag == "N", F.col("l_linenumber").cast("string"))
        .when(flag == "A", sized)
        .when(F.col("l_linestatus") == "O", named)
    )
    return t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("subject_id"),
        "l_linenumber",
        F.col("p_brand").alias("item_id"),
        value.alias("value"),
    )


def distinct_item_values(t: Tables) -> DataFrame:
    lines = _valued_lines(t)
    labels = t.part.select(
        F.col("p_brand").alias("item_id"), F.lower("p_brand").alias("label")
    ).distinct()
    return items.distinct_item_values(lines, labels)


def value_dictionary(t: Tables) -> DataFrame:
    return items.value_dictionary(_valued_lines(t))


def value_labels(t: Tables) -> DataFrame:
    labels = t.part.select(
        F.col("p_brand").alias("item_id"), F.lower("p_brand").alias("label")
    ).distinct()
    made = items.value_labels(items.value_dictionary(_valued_lines(t)), labels)
    return items.items_with_values(labels, made)


def value_token_items(t: Tables) -> DataFrame:
    lines = _valued_lines(t)
    return items.tokenise_values(lines, items.value_dictionary(lines)).select(
        "subject_id", "l_linenumber", "item_id"
    )


def unit_bag(t: Tables) -> DataFrame:
    events = events_before_end(unite_events([roles.order_events(t)]), roles.order_profile(t))
    return bag.unit_bags(events, roles.order_profile(t), list(UNITS))


def multi_item_bag(t: Tables) -> DataFrame:
    """Bags without the subjects that hold a single distinct item."""
    return bag.bag_of_events(unite_events([roles.order_events(t)]), drop_singletons=True)


def outcome_event_before_end(t: Tables) -> DataFrame:
    return outcome.label_outcome(roles.order_profile(t), outcome.EVENT_BEFORE_END).select(
        "subject_id", "unit", "label"
    )


def outcome_long_stay(t: Tables) -> DataFrame:
    return outcome.label_outcome(roles.order_profile(t), outcome.LONG_STAY).select(
        "subject_id", "unit", "label"
    )


def stay_cutoff(t: Tables) -> DataFrame:
    from ..operators.ranking import interpolated_percentile

    return interpolated_percentile(roles.order_profile(t), "min_to_end", 0.75).withColumnRenamed(
        "value", "cutoff"
    )


def eligible_subjects(t: Tables) -> DataFrame:
    """At-risk subjects of both outcomes at all five gaps."""
    profile = roles.order_profile(t)
    parts = [
        outcome.eligible_subjects(profile, o, GAPS, INFO).withColumn("outcome", F.lit(o))
        for o in (outcome.EVENT_BEFORE_END, outcome.LONG_STAY)
    ]
    return parts[0].unionByName(parts[1])


def cohort_counts(t: Tables) -> DataFrame:
    profile = roles.order_profile(t)
    eligible = outcome.eligible_subjects(profile, outcome.EVENT_BEFORE_END, GAPS, INFO)
    labelled = outcome.label_outcome(profile, outcome.EVENT_BEFORE_END)
    return outcome.cohort_counts(eligible.join(labelled, "subject_id"), ["unit", "system", "gap"])


def feature_frequency_filter(t: Tables) -> DataFrame:
    eligible = outcome.eligible_subjects(
        roles.order_profile(t), outcome.EVENT_BEFORE_END, (0,), INFO
    )
    return bag.filter_bag(roles.order_bag(t), eligible, THRESHOLD)


def concept_rollup(t: Tables) -> DataFrame:
    return bag.concept_rollup(roles.order_bag(t), roles.part_concepts(t)).withColumnRenamed(
        "item_id", "concept_id"
    )


def concept_inverse_map(t: Tables) -> DataFrame:
    return bag.concept_items(roles.part_concepts(t))


def _by_system(t: Tables, system: str) -> DataFrame:
    members = roles.order_profile(t).filter(F.col("system") == system)
    return roles.order_bag(t).join(members.select("subject_id"), "subject_id", "left_semi")


def feature_intersection(t: Tables) -> DataFrame:
    return bag.shared_items(_by_system(t, "carevue"), _by_system(t, "metavision"))


def order_mixed_subjects(t: Tables, b: DataFrame) -> DataFrame:
    """Subjects of the older system that hold an item of the other one: small parts (size 5 and less)."""
    foreign = t.part.filter(F.col("p_size") <= 5).select(
        F.col("p_partkey").cast("string").alias("item_id")
    )
    members = roles.order_profile(t).filter(F.col("system") == "carevue")
    mixed = b.join(members.select("subject_id"), "subject_id", "left_semi").join(
        foreign, "item_id", "left_semi"
    )
    return mixed.select("subject_id").distinct()


def drop_mixed_subjects(t: Tables) -> DataFrame:
    """Bags without subjects that hold an item of the other system."""
    b = roles.order_bag(t)
    return bag.drop_subjects(b, order_mixed_subjects(t, b))


QUERIES = {
    f.__name__: f
    for f in (
        bag_of_events,
        window_events_cascade,
        window_valued_events,
        window_events_by_day,
        start_end_events,
        events_union_dedup,
        scoped_events,
        source_bags,
        distinct_item_values,
        value_dictionary,
        value_labels,
        value_token_items,
        unit_bag,
        multi_item_bag,
        outcome_event_before_end,
        outcome_long_stay,
        stay_cutoff,
        eligible_subjects,
        cohort_counts,
        feature_frequency_filter,
        concept_rollup,
        concept_inverse_map,
        feature_intersection,
        drop_mixed_subjects,
    )
}

# --- SQL ---------------------------------------------------------------------


def _cascade(table: str, keys: tuple[str, ...], columns: str, where: str) -> str:
    """Union of one join per key, each needing the higher keys to be null."""
    legs = []
    for i, key in enumerate(keys):
        nulls = "".join(f" AND e.{k} IS NULL" for k in keys[:i])
        legs.append(
            f"SELECT {columns} FROM {table} e JOIN anchor a ON e.{key} = a.{key} "
            f"WHERE e.{key} IS NOT NULL{nulls} AND {where}"
        )
    return "\nUNION ALL\n".join(legs)


def _timed(table: str, keys: tuple[str, ...], days: int, item: str, more: str = "") -> str:
    window = (
        f"charttime >= anchor_time AND charttime < anchor_time + INTERVAL {days} DAY"
    )
    columns = (
        f"e.subject_id, {item} AS item_id, {sql_rounded_minutes('charttime', 'anchor_time')} "
        f"AS min_from_anchor, CAST(hour(charttime) AS INTEGER) AS hour_of_day{more}"
    )
    return _cascade(table, keys, columns, window)


_STAY, _ADM, _SUB = "stay_id", "admission_id", "subject_id"
_ITEM = "CAST(itemid AS VARCHAR)"


def _dated(table: str, keys: tuple[str, ...], time: str, item: str, day: int, extra: str = "") -> str:
    days = sql_days(time, "anchor_time")
    return _cascade(
        table,
        keys,
        f"e.subject_id, {item} AS item_id, {days} AS days_from_anchor",
        f"{time} IS NOT NULL AND {days} = {day}{extra}",
    )


def _drug(day: int) -> str:
    return "\nUNION ALL\n".join(
        _dated("drug", (_STAY, _ADM), f"{tag}date", f"item || ',{tag}'", day) for tag in ("start", "end")
    )


def _micro_dated(day: int) -> str:
    return _dated("micro", (_ADM, _SUB), "chartdate", "item_id", day, " AND charttime IS NULL")


_EVENT_ROLES = ("event_anchor", "chart", "input_cv", "lab", "micro", "drug")
_EVENT_ANCHOR = "SELECT * FROM event_anchor"


def _all_sources() -> dict[str, str]:
    mv = "SELECT subject_id, admission_id, stay_id, itemid + 1000 AS itemid, charttime FROM chart"
    out = "SELECT subject_id, admission_id, stay_id, itemid + 1000 AS itemid, charttime FROM input_cv"
    timed = [
        _timed("chart", (_STAY, _ADM), 1, _ITEM),
        _timed("mv", (_STAY, _ADM), 1, _ITEM),
        _timed("input_cv", (_STAY, _ADM, _SUB), 1, _ITEM),
        _timed("outp", (_STAY, _ADM, _SUB), 1, _ITEM),
        _timed("lab", (_ADM, _SUB), 1, _ITEM),
        _timed("micro", (_ADM, _SUB), 1, "e.item_id"),
    ]
    dated = [_micro_dated(0), _drug(0)]
    return {
        "anchor": _EVENT_ANCHOR,
        "mv": mv,
        "outp": out,
        "timed": "\nUNION ALL\n".join(timed),
        "dated": "\nUNION ALL\n".join(dated),
        "united": """SELECT DISTINCT * FROM (
            SELECT subject_id, item_id, min_from_anchor,
                   CAST(NULL AS INTEGER) AS days_from_anchor FROM timed
            UNION ALL SELECT subject_id, item_id, NULL, days_from_anchor FROM dated)""",
    }


_VALUED = """SELECT l_orderkey AS subject_id, l_linenumber, p_brand AS item_id,
    CASE WHEN l_returnflag = 'N' THEN CAST(l_linenumber AS VARCHAR)
         WHEN l_returnflag = 'A' THEN p_type || '-' || p_size
         WHEN l_linestatus = 'O' THEN p_name || ' @' || l_linenumber END AS value
    FROM lineitem JOIN part ON l_partkey = p_partkey"""
_NORMAL = """lower(translate(translate(value, '0123456789', ''),
    '#%^&*!@()-=/.:;,\\', '                 '))"""
_VALUES = f"""SELECT *, CAST(dense_rank() OVER (PARTITION BY item_id ORDER BY md5(value))
    AS INTEGER) AS k FROM (SELECT DISTINCT item_id, {_NORMAL} AS value FROM valued
    WHERE trim({_NORMAL}, ' ') <> '')"""

_CUTOFF = "(SELECT quantile_cont(min_to_end, 0.75) FROM order_profile)"


def _eligible(outcome_name: str, gaps: tuple[int, ...], info: int = INFO) -> str:
    rows = ", ".join(f"({float(g)}::DOUBLE)" for g in gaps)
    extra = (
        f" AND NOT coalesce(min_to_death <= {_CUTOFF}, false)"
        if outcome_name == outcome.LONG_STAY
        else ""
    )
    return f"""SELECT subject_id, gap FROM order_profile, (VALUES {rows}) g(gap)
        WHERE NOT coalesce(min_to_death <= {info} + gap, false)
          AND NOT coalesce(min_to_end <= {info} + gap, false){extra}"""


_LABEL = "CASE WHEN coalesce(min_to_death <= min_to_end, false) THEN 1 ELSE -1 END"

ORACLES = {
    "bag_of_events": with_roles(
        ("order_events",),
        """SELECT subject_id, item_id, count(*) AS cnt
           FROM (SELECT DISTINCT * FROM order_events) GROUP BY subject_id, item_id""",
    ),
    "window_events_cascade": with_roles(
        ("order_anchor",),
        _timed("lines", (_STAY, _ADM, _SUB), roles.WINDOW_DAYS, _ITEM),
        anchor="SELECT * FROM order_anchor",
        lines="""SELECT o_custkey AS subject_id,
            CASE WHEN l_returnflag <> 'R' THEN o_custkey * 10000 + year(o_orderdate) END
              AS admission_id,
            CASE WHEN l_returnflag = 'N' THEN l_orderkey END AS stay_id,
            l_partkey AS itemid, l_shipdate AS charttime
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "window_valued_events": with_roles(
        ("event_anchor", "chart"),
        _timed("chart", (_STAY, _ADM), 1, _ITEM, ", value"),
        anchor=_EVENT_ANCHOR,
    ),
    "window_events_by_day": with_roles(
        ("event_anchor", "micro"), _micro_dated(1), anchor=_EVENT_ANCHOR
    ),
    "start_end_events": with_roles(("event_anchor", "drug"), _drug(1), anchor=_EVENT_ANCHOR),
    "events_union_dedup": with_roles(_EVENT_ROLES, "SELECT * FROM united", **_all_sources()),
    "scoped_events": with_roles(
        (*_EVENT_ROLES, "event_profile"),
        """SELECT u.* FROM united u JOIN event_profile USING (subject_id)
           WHERE coalesce(min_from_anchor < min_to_end, false)
              OR coalesce(days_from_anchor < floor(min_to_end / 1440), false)""",
        **_all_sources(),
    ),
    "source_bags": with_roles(
        _EVENT_ROLES,
        """SELECT subject_id, item_id, count(*) AS cnt FROM united
           WHERE NOT item_id LIKE '%,end' GROUP BY ALL""",
        **_all_sources(),
    ),
    "distinct_item_values": with_roles(
        (), "SELECT DISTINCT item_id, value, lower(item_id) AS label FROM valued", valued=_VALUED
    ),
    "value_dictionary": with_roles((), _VALUES, valued=_VALUED),
    "value_labels": with_roles(
        (),
        """SELECT DISTINCT p_brand AS item_id, lower(p_brand) AS label FROM part
           UNION ALL SELECT item_id || '_' || k, lower(item_id) || ' ' || value FROM dict""",
        valued=_VALUED,
        dict=_VALUES,
    ),
    "value_token_items": with_roles(
        (),
        f"""SELECT v.subject_id, v.l_linenumber,
              CASE WHEN d.k IS NULL THEN v.item_id ELSE v.item_id || '_' || d.k END AS item_id
            FROM valued v LEFT JOIN dict d ON v.item_id = d.item_id
              AND {_NORMAL.replace('value', 'v.value')} = d.value""",
        valued=_VALUED,
        dict=_VALUES,
    ),
    "unit_bag": with_roles(
        ("order_bag",),
        "SELECT b.*, unit FROM order_bag b JOIN order_profile USING (subject_id)",
    ),
    "multi_item_bag": with_roles(
        ("order_events",),
        """SELECT * FROM bag WHERE subject_id IN
           (SELECT subject_id FROM bag GROUP BY subject_id HAVING count(*) > 1)""",
        bag="""SELECT subject_id, item_id, count(*) AS cnt
           FROM (SELECT DISTINCT * FROM order_events) GROUP BY subject_id, item_id""",
    ),
    "outcome_event_before_end": with_roles(
        ("order_profile",), f"SELECT subject_id, unit, {_LABEL} AS label FROM order_profile"
    ),
    "outcome_long_stay": with_roles(
        ("order_profile",),
        f"""SELECT subject_id, unit, CASE WHEN min_to_end > {_CUTOFF} THEN 1 ELSE -1 END AS label
            FROM order_profile""",
    ),
    "stay_cutoff": with_roles(("order_profile",), f"SELECT {_CUTOFF} AS cutoff"),
    "eligible_subjects": with_roles(
        ("order_profile",),
        "\nUNION ALL\n".join(
            f"SELECT *, '{o}' AS outcome FROM ({_eligible(o, GAPS)})"
            for o in (outcome.EVENT_BEFORE_END, outcome.LONG_STAY)
        ),
    ),
    "cohort_counts": with_roles(
        ("order_profile",),
        f"""SELECT unit, system, gap, count(*) AS n,
              count(*) FILTER ({_LABEL} = 1) AS n_positive
            FROM ({_eligible(outcome.EVENT_BEFORE_END, GAPS)}) JOIN order_profile USING (subject_id)
            GROUP BY unit, system, gap""",
    ),
    "feature_frequency_filter": with_roles(
        ("order_bag",),
        f"""SELECT k.* FROM kept k JOIN (SELECT item_id FROM kept GROUP BY item_id
              HAVING count(*) > {THRESHOLD}) USING (item_id)""",
        eligible=_eligible(outcome.EVENT_BEFORE_END, (0,)),
        kept="SELECT b.* FROM order_bag b JOIN eligible USING (subject_id)",
    ),
    "concept_rollup": with_roles(
        ("order_bag", "part_concepts"),
        """SELECT subject_id, concept_id, CAST(sum(cnt) AS BIGINT) AS cnt
           FROM order_bag JOIN part_concepts USING (item_id) GROUP BY ALL""",
    ),
    "concept_inverse_map": with_roles(
        ("part_concepts",),
        """SELECT concept_id, item_id, count(*) OVER (PARTITION BY concept_id) AS n_items
           FROM part_concepts""",
    ),
    "feature_intersection": with_roles(
        ("order_bag",),
        """SELECT item_id FROM order_bag JOIN order_profile USING (subject_id)
             WHERE system = 'carevue'
           INTERSECT SELECT item_id FROM order_bag JOIN order_profile USING (subject_id)
             WHERE system = 'metavision'""",
    ),
    "drop_mixed_subjects": with_roles(
        ("order_bag",),
        """SELECT * FROM order_bag WHERE subject_id NOT IN
           (SELECT subject_id FROM order_bag JOIN order_profile USING (subject_id)
            JOIN part ON item_id = CAST(p_partkey AS VARCHAR)
            WHERE system = 'carevue' AND p_size <= 5)""",
    ),
}
