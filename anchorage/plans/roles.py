"""Clinical roles played by the star-schema tables.

Two worlds.  *Orders*: a customer is a subject, the first order the anchor,
line items are events, parts are items.  *Events*: a user is a subject, a
calendar week an admission, a day a stay, an event type a care unit.

``SQL`` holds the same definitions as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.timing import midnight, rounded_minutes, whole_minutes
from ..operators.ranking import neighbour_values, time_chunk
from ..session import prepare, spread

WINDOW_DAYS = 365
INFO = WINDOW_DAYS * 1440
GAPS = tuple(d * 1440 for d in (0, 180, 360, 540, 720))
THRESHOLD = 4
UNITS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
EVENT_UNITS = ("click", "error", "purchase", "signup", "view")
SYSTEM_A_REGIONS = ("AFRICA", "AMERICA")


class Tables:
    """Lazy parquet scans of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        # kept as an attribute, so a file's schema is read once
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)
        return table

    def texts(self) -> DataFrame:
        """Documents, spread over the cores for work on whole texts."""
        return spread(self.documents, "doc_id")


# --- orders world -----------------------------------------------------------


def order_systems(t: Tables) -> DataFrame:
    region = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    system = F.when(F.col("r_name").isin(*SYSTEM_A_REGIONS), "carevue").otherwise("metavision")
    return region.select(F.col("n_nationkey").alias("nation"), system.alias("system"))


def order_anchor(t: Tables) -> DataFrame:
    """First order per customer, with stay and admission ids."""
    first = F.min(F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("key")))
    return (
        t.orders.groupBy(F.col("o_custkey").alias("subject_id"))
        .agg(first.alias("f"))
        .select(
            "subject_id",
            (F.col("subject_id") * 10000 + F.year("f.at")).alias("admission_id"),
            F.col("f.key").alias("stay_id"),
            F.col("f.at").alias("anchor_time"),
        )
    )


def order_profile(t: Tables) -> DataFrame:
    """subject_id, unit, severity, system, anchor_time, min_to_end, min_to_death."""
    urgent = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    times = t.orders.groupBy(F.col("o_custkey").alias("subject_id")).agg(
        F.min("o_orderdate").alias("anchor_time"),
        F.max("o_orderdate").alias("end_time"),
        F.min(F.when(urgent, F.col("o_orderdate"))).alias("death_time"),
    )
    people = t.customer.select(
        F.col("c_custkey").alias("subject_id"),
        F.col("c_mktsegment").alias("unit"),
        F.col("c_acctbal").alias("severity"),
        F.col("c_nationkey").alias("nation"),
    ).join(order_systems(t), "nation")
    return times.join(people, "subject_id").select(
        "subject_id",
        "unit",
        "severity",
        "system",
        "anchor_time",
        rounded_minutes("end_time", "anchor_time").alias("min_to_end"),
        rounded_minutes("death_time", "anchor_time").alias("min_to_death"),
    )


def order_lines(t: Tables) -> DataFrame:
    """Line items as events; returned and accepted lines lack upper keys."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    flag = F.col("l_returnflag")
    admission = F.col("o_custkey") * 10000 + F.year("o_orderdate")
    return lines.select(
        F.col("o_custkey").alias("subject_id"),
        F.when(flag != "R", admission).alias("admission_id"),
        F.when(flag == "N", F.col("l_orderkey")).alias("stay_id"),
        F.col("l_partkey").alias("itemid"),
        F.col("l_shipdate").alias("charttime"),
    )


def order_events(t: Tables) -> DataFrame:
    """(subject_id, item_id, min_from_anchor) in the window of the anchor."""
    from ..operators.extract import in_window

    anchor = t.orders.groupBy(F.col("o_custkey").alias("subject_id")).agg(
        F.min("o_orderdate").alias("anchor_time")
    )
    # the orders get their anchor first, so the line items move only once
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("subject_id")).join(
        anchor, "subject_id"
    )
    return (
        t.lineitem.select("l_orderkey", "l_partkey", "l_shipdate")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .filter(in_window("l_shipdate", 0, WINDOW_DAYS))
        .select(
            "subject_id",
            F.col("l_partkey").cast("string").alias("item_id"),
            rounded_minutes("l_shipdate", "anchor_time").alias("min_from_anchor"),
        )
    )


def order_bag(t: Tables) -> DataFrame:
    from ..operators.bag import bag_of_events
    from ..operators.extract import events_before_end, unite_events

    events = unite_events([order_events(t)])
    return bag_of_events(events_before_end(events, order_profile(t)))


def part_concepts(t: Tables) -> DataFrame:
    from ..functions.text import words

    return t.part.select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.explode(words("p_name")).alias("concept_id"),
    ).distinct()


# --- events world -----------------------------------------------------------


def event_rows(t: Tables) -> DataFrame:
    """Events with the ids of their admission (week) and stay (day)."""
    return t.events.select(
        F.col("user_id").alias("subject_id"),
        (F.col("user_id") * 100 + F.weekofyear("ts")).alias("admission_id"),
        (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("stay_id"),
        "event_id",
        "ts",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def transfers(t: Tables) -> DataFrame:
    """Each event is a move into a unit until the user's next event."""
    rows = time_chunk(event_rows(t), "ts", "day")
    both = neighbour_values(
        rows, ["subject_id"], "ts", {"ts": "out_time"}, {"event_type": "prev_unit"}
    )
    return both.select(
        "subject_id",
        "admission_id",
        "stay_id",
        F.col("ts").alias("in_time"),
        "out_time",
        F.col("event_type").alias("unit"),
        "prev_unit",
        (whole_minutes("out_time", "ts") / 60).alias("los"),
    )


def stays(t: Tables, moves: DataFrame | None = None) -> DataFrame:
    moves = transfers(t) if moves is None else moves
    people = t.customer.select(
        F.col("c_custkey").alias("subject_id"), F.col("c_nationkey").alias("nation")
    ).join(order_systems(t), "nation")
    spans = moves.groupBy("subject_id", "admission_id", "stay_id").agg(
        F.min("in_time").alias("in_time"), F.max("out_time").alias("out_time")
    )
    return spans.join(people.select("subject_id", "system"), "subject_id")


def admissions(t: Tables, moves: DataFrame | None = None) -> DataFrame:
    moves = transfers(t) if moves is None else moves

    def any_of(*kinds: str):
        return F.max(F.col("unit").isin(*kinds).cast("int"))

    return moves.groupBy("subject_id", "admission_id").agg(
        F.min("in_time").alias("admit_time"),
        F.max("out_time").alias("disch_time"),
        F.min("unit").alias("admission_location"),
        F.max("unit").alias("discharge_location"),
        any_of("purchase").alias("has_ioevents_data"),
        any_of("view", "click").alias("has_chartevents_data"),
    )


def patients(t: Tables) -> DataFrame:
    """Birth is the customer's first order, death a late severe error."""
    severe = (F.col("event_type") == "error") & (F.col("k") >= 90)
    death = event_rows(t).groupBy("subject_id").agg(F.min(F.when(severe, F.col("ts"))).alias("dod"))
    birth = t.orders.groupBy(F.col("o_custkey").alias("subject_id")).agg(
        F.min("o_orderdate").alias("dob")
    )
    return death.join(birth, "subject_id", "left")


def severity(t: Tables) -> DataFrame:
    return event_rows(t).groupBy("stay_id").agg(F.round(F.sum("value"), 2).alias("severity"))


def event_anchor(t: Tables) -> DataFrame:
    first = F.min(F.struct("ts", "admission_id", "stay_id"))
    return (
        event_rows(t)
        .groupBy("subject_id")
        .agg(first.alias("f"))
        .select("subject_id", "f.admission_id", "f.stay_id", F.col("f.ts").alias("anchor_time"))
    )


def event_profile(t: Tables) -> DataFrame:
    return (
        t.events.groupBy(F.col("user_id").alias("subject_id"))
        .agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
        .select("subject_id", rounded_minutes("b", "a").alias("min_to_end"))
    )


def event_sources(t: Tables) -> dict[str, DataFrame]:
    """The eight event tables, all drawn from the events."""
    rows = event_rows(t)
    kind = F.col("event_type")
    stay = F.when(kind != "view", F.col("stay_id")).alias("stay_id")
    admission = F.when(kind != "signup", F.col("admission_id")).alias("admission_id")
    ids = ["subject_id", admission, stay]
    note = F.concat_ws(" @", "event_type", F.col("k").cast("string"))
    chart = rows.select(
        "subject_id",
        "admission_id",
        stay,
        F.col("k").alias("itemid"),
        F.col("ts").alias("charttime"),
        F.when(kind != "error", note).alias("value"),
    )
    micro = rows.select(
        "subject_id",
        admission,
        F.col("k").alias("spec_itemid"),
        F.when(kind != "error", F.floor("value").cast("long")).alias("org_itemid"),
        F.when(kind == "click", 1).when(kind == "view", 2).cast("long").alias("ab_itemid"),
        F.when(kind != "purchase", F.col("ts")).alias("charttime"),
        midnight("ts").alias("chartdate"),
    )
    both_null = F.when(kind.isin("view", "signup"), None).otherwise(F.col("stay_id"))
    three = rows.select(
        "subject_id",
        admission,
        both_null.alias("stay_id"),
        (F.col("k") + 2000).alias("itemid"),
        F.col("ts").alias("charttime"),
    )
    return {
        "chart": chart,
        "input_mv": rows.select(
            "subject_id", "admission_id", stay, (F.col("k") + 1000).alias("itemid"),
            F.col("ts").alias("starttime"),
        ),
        "input_cv": three,
        "output": three.withColumn("itemid", F.col("itemid") + 1000),
        "lab": rows.select(
            "subject_id", admission, (F.col("k") + 4000).alias("itemid"), F.col("ts").alias("charttime")
        ),
        "microbiology_timed": micro,
        "microbiology_dated": micro,
        "drug": rows.select(
            "subject_id",
            "admission_id",
            stay,
            F.concat(F.lit('"'), kind, F.lit('"')).alias("drug_name"),
            F.concat(F.lit("r"), F.floor("value").cast("string")).alias("route"),
            midnight("ts").alias("startdate"),
            F.when(kind != "error", midnight("ts") + F.make_dt_interval(F.lit(1))).alias("enddate"),
        ),
    }


# --- the same roles as SQL ---------------------------------------------------


def sql_whole_minutes(a: str, b: str) -> str:
    return f"CAST(trunc((epoch_us({a}) - epoch_us({b})) / 60000000.0) AS BIGINT)"


def sql_rounded_minutes(a: str, b: str) -> str:
    d = f"(epoch_us({a}) - epoch_us({b}))"
    return f"(sign({d}) * ((abs({d}) + 300000) // 600000) / 100.0)"


def sql_days(a: str, anchor: str) -> str:
    day = f"epoch_us(CAST(CAST({anchor} AS DATE) AS TIMESTAMP))"
    return f"CAST(trunc((epoch_us({a}) - {day}) / 86400000000.0) AS INTEGER)"


def sql_words(text: str, least: int = 1) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{{least},}}')"


SQL = {
    "order_systems": """SELECT n_nationkey AS nation,
        CASE WHEN r_name IN ('AFRICA', 'AMERICA') THEN 'carevue' ELSE 'metavision' END AS system
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "order_anchor": """SELECT o_custkey AS subject_id,
        o_custkey * 10000 + year(o_orderdate) AS admission_id,
        o_orderkey AS stay_id, o_orderdate AS anchor_time
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
              FROM orders) WHERE rn = 1""",
    "order_times": """SELECT o_custkey AS subject_id, min(o_orderdate) AS anchor_time,
        max(o_orderdate) AS end_time,
        min(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN o_orderdate END)
          AS death_time
        FROM orders GROUP BY o_custkey""",
    "order_profile": f"""SELECT subject_id, c_mktsegment AS unit, c_acctbal AS severity, system,
        anchor_time, {sql_rounded_minutes('end_time', 'anchor_time')} AS min_to_end,
        {sql_rounded_minutes('death_time', 'anchor_time')} AS min_to_death
        FROM order_times JOIN customer ON c_custkey = subject_id
        JOIN order_systems ON nation = c_nationkey""",
    "order_events": f"""SELECT a.subject_id, CAST(l_partkey AS VARCHAR) AS item_id,
        {sql_rounded_minutes('l_shipdate', 'anchor_time')} AS min_from_anchor
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN order_anchor a ON o_custkey = a.subject_id
        WHERE l_shipdate >= anchor_time AND l_shipdate < anchor_time + INTERVAL {WINDOW_DAYS} DAY""",
    "order_bag": """SELECT subject_id, item_id, count(*) AS cnt
        FROM (SELECT DISTINCT subject_id, item_id, min_from_anchor FROM order_events)
        JOIN order_profile USING (subject_id)
        WHERE min_from_anchor < min_to_end GROUP BY subject_id, item_id""",
    "part_concepts": f"""SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS item_id, w AS concept_id
        FROM (SELECT p_partkey, unnest({sql_words('p_name')}) AS w FROM part)""",
    "event_rows": """SELECT user_id AS subject_id, user_id * 100 + week(ts) AS admission_id,
        user_id * 1000 + dayofyear(ts) AS stay_id, event_id, ts, event_type, value,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "transfers": f"""SELECT subject_id, admission_id, stay_id, ts AS in_time, out_time,
        event_type AS unit, prev_unit, {sql_whole_minutes('out_time', 'ts')} / 60.0 AS los
        FROM (SELECT *, lead(ts) OVER w AS out_time, lag(event_type) OVER w AS prev_unit
              FROM event_rows WINDOW w AS (PARTITION BY subject_id ORDER BY ts))""",
    "stays": """SELECT subject_id, admission_id, stay_id, in_time, out_time, system
        FROM (SELECT subject_id, admission_id, stay_id, min(in_time) AS in_time,
                     max(out_time) AS out_time
              FROM transfers GROUP BY ALL)
        JOIN customer ON c_custkey = subject_id JOIN order_systems ON nation = c_nationkey""",
    "admissions": """SELECT subject_id, admission_id, min(in_time) AS admit_time,
        max(out_time) AS disch_time, min(unit) AS admission_location,
        max(unit) AS discharge_location,
        max(CASE WHEN unit = 'purchase' THEN 1 ELSE 0 END) AS has_ioevents_data,
        max(CASE WHEN unit IN ('view', 'click') THEN 1 ELSE 0 END) AS has_chartevents_data
        FROM transfers GROUP BY subject_id, admission_id""",
    "patients": """SELECT subject_id, dod, dob FROM
        (SELECT subject_id, min(CASE WHEN event_type = 'error' AND k >= 90 THEN ts END) AS dod
         FROM event_rows GROUP BY subject_id)
        LEFT JOIN (SELECT o_custkey AS subject_id, min(o_orderdate) AS dob FROM orders
                   GROUP BY o_custkey) USING (subject_id)""",
    "severity": """SELECT stay_id, round(sum(value), 2) AS severity FROM event_rows
        GROUP BY stay_id""",
    "event_anchor": """SELECT subject_id, admission_id, stay_id, ts AS anchor_time
        FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY ts) AS rn
              FROM event_rows) WHERE rn = 1""",
    "event_profile": f"""SELECT user_id AS subject_id,
        {sql_rounded_minutes('max(ts)', 'min(ts)')} AS min_to_end FROM events GROUP BY user_id""",
    "chart": """SELECT subject_id, admission_id,
        CASE WHEN event_type <> 'view' THEN stay_id END AS stay_id, k AS itemid, ts AS charttime,
        CASE WHEN event_type <> 'error' THEN event_type || ' @' || k END AS value
        FROM event_rows""",
    "input_cv": """SELECT subject_id,
        CASE WHEN event_type <> 'signup' THEN admission_id END AS admission_id,
        CASE WHEN event_type NOT IN ('view', 'signup') THEN stay_id END AS stay_id,
        k + 2000 AS itemid, ts AS charttime FROM event_rows""",
    "lab": """SELECT subject_id,
        CASE WHEN event_type <> 'signup' THEN admission_id END AS admission_id,
        k + 4000 AS itemid, ts AS charttime FROM event_rows""",
    "micro": """SELECT subject_id,
        CASE WHEN event_type <> 'signup' THEN admission_id END AS admission_id,
        coalesce(CAST(k AS VARCHAR), '') || ','
          || coalesce(CASE WHEN event_type <> 'error'
                      THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END, '') || ','
          || CASE event_type WHEN 'click' THEN '1' WHEN 'view' THEN '2' ELSE '' END AS item_id,
        CASE WHEN event_type <> 'purchase' THEN ts END AS charttime,
        CAST(CAST(ts AS DATE) AS TIMESTAMP) AS chartdate FROM event_rows""",
    "drug": """SELECT subject_id, admission_id,
        CASE WHEN event_type <> 'view' THEN stay_id END AS stay_id,
        event_type || ',r' || CAST(floor(value) AS BIGINT) AS item,
        CAST(CAST(ts AS DATE) AS TIMESTAMP) AS startdate,
        CASE WHEN event_type <> 'error'
             THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY END AS enddate
        FROM event_rows""",
}

_NEEDS = {
    "order_profile": ("order_systems", "order_times"),
    "order_events": ("order_anchor",),
    "order_bag": ("order_events", "order_profile"),
    "transfers": ("event_rows",),
    "stays": ("transfers", "order_systems"),
    "admissions": ("transfers",),
    "patients": ("event_rows",),
    "severity": ("event_rows",),
    "event_anchor": ("event_rows",),
    "chart": ("event_rows",),
    "input_cv": ("event_rows",),
    "lab": ("event_rows",),
    "micro": ("event_rows",),
    "drug": ("event_rows",),
}


def with_roles(names: tuple[str, ...], body: str, **extra: str) -> str:
    """``body`` under the named role expressions and what they need."""
    seen: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            visit(needed)
        if name not in seen:
            seen.append(name)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({SQL[n]})" for n in seen] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
