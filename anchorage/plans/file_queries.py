"""Queries over tables that were written to files and read back, and the small item operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import bag, concepts, extract, items, outcome, splits, vocabulary
from ..session import stage_dir
from ..sources import files
from . import roles
from .event_queries import _LABEL
from .roles import UNITS, Tables, with_roles
from .text_queries import _ONE_BYTE, _distinct_words, _medical

SEED = 7
PROFILE = "subject_id long, unit string, severity double, system string, min_to_end double, min_to_death double"
DICTIONARIES = {
    "chart": "item_id long, label string",
    "lab": "item_id long, label string, fluid string, category string",
    "item": "item_id long, label string, fluid string, category string, linksto string, system string",
}
UNIT, SOURCE, METHOD = UNITS[1], "orders", "spanning"


def _path(t: Tables, name: str) -> str:
    return f"{stage_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def profile_file(t: Tables) -> DataFrame:
    """The cohort profile as a delimited file."""
    path = _path(t, "profile")
    files.write_delimited(roles.order_profile(t).select(*[c.split()[0] for c in PROFILE.split(", ")]), path)
    return files.read_delimited(t.spark, path, PROFILE)


def _items(t: Tables) -> DataFrame:
    """Parts as dictionary items."""
    return t.part.select(
        F.col("p_partkey").cast("long").alias("item_id"),
        F.col("p_name").alias("label"),
        F.concat(F.lit("f"), (F.col("p_size") % 5).cast("string")).alias("fluid"),
        F.col("p_type").alias("category"),
        F.when(F.col("p_size") <= 10, "microbiologyevents").when(F.col("p_size") <= 40, "chartevents").alias("linksto"),
        F.when(F.col("p_size") % 2 == 0, "carevue").otherwise("metavision").alias("system"),
    )


def dictionary_files(t: Tables) -> DataFrame:
    """Chart, lab and full item dictionaries as delimited files, in one table."""
    own = _items(t)
    made = {"chart": items.chart_dictionary(own), "lab": items.lab_dictionary(own), "item": own}
    found = None
    for name, schema in DICTIONARIES.items():
        path = _path(t, name)
        files.write_delimited(made[name], path)
        read = files.read_delimited(t.spark, path, schema).withColumn("dictionary", F.lit(name))
        found = read if found is None else found.unionByName(read, allowMissingColumns=True)
    return found


def chart_item_subset(t: Tables) -> DataFrame:
    """Items of one system that are not linked to microbiology."""
    return items.chart_items(_items(t), "carevue")


def window_extract_files(t: Tables) -> DataFrame:
    """Extracts of two sources, each written twice; one source of the window read back."""
    path = _path(t, "window")
    orders = roles.order_events(t)
    clicks = t.events.select(F.col("user_id").alias("subject_id"), F.col("event_type").alias("item_id"), F.lit(0.0).alias("min_from_anchor"))
    for _ in range(2):
        files.write_window({SOURCE: orders, "events": clicks}, path, 0, roles.WINDOW_DAYS)
    return files.read_partition(t.spark, path, source=SOURCE).select("subject_id", "item_id", "min_from_anchor", "window")


def unit_matrix_files(t: Tables) -> DataFrame:
    """Bags by unit, written twice; one unit read back."""
    path = _path(t, "units")
    bags = bag.unit_bags(roles.order_events(t), roles.order_profile(t), list(UNITS))
    for _ in range(2):
        files.write_partitioned(bags, path, ["unit"], "overwrite")
    return files.read_partition(t.spark, path, unit=UNIT).select("subject_id", "item_id", "cnt")


def concept_map_files(t: Tables) -> DataFrame:
    """Item concepts by method, written by method; those of one method chosen from what is read."""
    path = _path(t, "concepts")
    pairs = roles.part_concepts(t)
    for method, own in (("all", pairs), (METHOD, pairs.where(F.length("concept_id") > 5))):
        files.write_partitioned(own.withColumn("method", F.lit(method)), path, ["method"], "overwrite")
    return concepts.choose_method(t.spark.read.parquet(path), METHOD).select("item_id", "concept_id")


def holdout_files(t: Tables) -> DataFrame:
    """Holdouts made once and read from then on."""
    path = _path(t, "holdouts")
    labelled = outcome.label_outcome(roles.order_profile(t), outcome.EVENT_BEFORE_END)
    files.load_or_make(t.spark, path, lambda: splits.stratified_holdouts(labelled, ["unit"], 3, seed=SEED))
    return files.load_or_make(t.spark, path, lambda: labelled.limit(0))


def vocabulary_files(t: Tables) -> DataFrame:
    """A vocabulary as a list of words, and a column of a delimited list."""
    words, lines = _path(t, "words"), _path(t, "lines")
    files.write_words(vocabulary.build_vocabulary([vocabulary.source_words(t.nation, "n_name", "plain"), vocabulary.source_words(t.region, "r_name", "plain")]), words)
    files.write_words(t.supplier.select(F.concat_ws("|", "s_suppkey", F.lit("x"), "s_name", F.lit("")).alias("word")), lines)
    names = files.read_column(t.spark, lines, "|", 2).select(F.col("text").alias("word"))
    return files.read_words(t.spark, words).unionByName(names)


def correction_files(t: Tables) -> DataFrame:
    """Corrections of the words of part names by the benchmark's vocabulary, as a delimited file."""
    path = _path(t, "corrections")
    seen = vocabulary.token_counts(t.part, "p_name").select("word")
    files.write_delimited(vocabulary.correct_spelling(seen, _medical(t)), path)
    return files.read_delimited(t.spark, path, "word string, corrected string")


def harmonised_extract(t: Tables) -> DataFrame:
    """An extract under its own column names, with canonical ones."""
    own = roles.order_events(t).select(
        "subject_id", F.lit(0).alias("itemid"), F.col("item_id").alias("itemid_ind"), F.col("min_from_anchor").alias("min_icuin_to_start")
    )
    return extract.harmonise_extract(own)


def mapped_items(t: Tables) -> DataFrame:
    """Tidied composite ids of the items with a concept."""
    keyed = roles.part_concepts(t).select(
        F.concat(F.lit("("), "item_id", F.lit(")")).alias("item_id"), F.when(F.length("concept_id") > 4, F.col("concept_id")).alias("concept_id")
    )
    return bag.mapped_item_ids(keyed)


def criteria_subjects(t: Tables) -> DataFrame:
    """Subjects with a bag in two of the units."""
    return bag.subjects_by_criteria(roles.order_profile(t), roles.order_bag(t), {"unit": list(UNITS[:2])})


def original_item_ids(t: Tables) -> DataFrame:
    """Staged document names with the drug items they stand for."""
    docs = t.part.select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("doc_id"))
    lookup = t.part.where("p_size <= 25").select(
        F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("doc_id"), F.col("p_name").alias("item_id")
    )
    return concepts.with_original_ids(docs, lookup).select("doc_id", "item_id")


QUERIES = {
    f.__name__: f
    for f in (
        profile_file,
        dictionary_files,
        chart_item_subset,
        window_extract_files,
        unit_matrix_files,
        concept_map_files,
        holdout_files,
        vocabulary_files,
        correction_files,
        harmonised_extract,
        mapped_items,
        criteria_subjects,
        original_item_ids,
    )
}

# --- SQL ---------------------------------------------------------------------

_ITEMS = """SELECT CAST(p_partkey AS BIGINT) AS item_id, p_name AS label, 'f' || (p_size % 5) AS fluid, p_type AS category,
    CASE WHEN p_size <= 10 THEN 'microbiologyevents' WHEN p_size <= 40 THEN 'chartevents' END AS linksto,
    CASE WHEN p_size % 2 = 0 THEN 'carevue' ELSE 'metavision' END AS system FROM part"""

ORACLES = {
    "profile_file": with_roles(
        ("order_profile",), "SELECT subject_id, unit, severity, system, min_to_end, min_to_death FROM order_profile"
    ),
    "dictionary_files": f"""SELECT 'chart' AS dictionary, item_id, label, NULL AS fluid, NULL AS category, NULL AS linksto, NULL AS system FROM ({_ITEMS})
        UNION ALL SELECT 'lab', item_id, label, fluid, category, NULL, NULL FROM ({_ITEMS})
        UNION ALL SELECT 'item', * FROM ({_ITEMS})""",
    "chart_item_subset": f"SELECT * FROM ({_ITEMS}) WHERE linksto IS DISTINCT FROM 'microbiologyevents' AND system = 'carevue'",
    "window_extract_files": with_roles(
        ("order_events",), f"SELECT subject_id, item_id, min_from_anchor, '0to{24 * roles.WINDOW_DAYS}hrs' AS window FROM order_events"
    ),
    "unit_matrix_files": with_roles(
        ("order_events", "order_profile"),
        f"""SELECT subject_id, item_id, count(*) AS cnt FROM order_events JOIN order_profile USING (subject_id)
            WHERE unit = '{UNIT}' GROUP BY subject_id, item_id""",
    ),
    "concept_map_files": with_roles(("part_concepts",), "SELECT item_id, concept_id FROM part_concepts WHERE length(concept_id) > 5"),
    "holdout_files": with_roles(
        ("order_profile",),
        f"""SELECT subject_id, unit, label, CAST(iter AS INTEGER) AS iter,
              CASE WHEN row_number() OVER (PARTITION BY iter, unit, label ORDER BY md5('{SEED}:' || iter || ':' || subject_id), subject_id)
                   <= CASE WHEN label = 1 THEN test_pos ELSE n_test - test_pos END THEN 'test' ELSE 'train' END AS role
            FROM labelled JOIN sizes USING (unit), range(3) r(iter)""",
        labelled=f"SELECT *, {_LABEL} AS label FROM order_profile",
        sizes="""SELECT unit, CAST(ceil(0.33 * n) AS BIGINT) AS n_test, CAST(floor(ceil(0.33 * n) * pos / n + 0.5) AS BIGINT) AS test_pos
            FROM (SELECT unit, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS pos FROM labelled GROUP BY unit)""",
    ),
    "vocabulary_files": """SELECT word FROM (SELECT n_name AS word FROM nation UNION SELECT r_name FROM region)
        UNION ALL SELECT s_name FROM supplier""",
    "correction_files": f"""WITH med AS ({_distinct_words("benchmark", "text")}), seen AS ({_distinct_words("part", "p_name")}),
        known AS (SELECT word FROM med UNION SELECT lower(word) FROM med WHERE upper(word) = word),
        best AS (SELECT word, min({{'d': d, 'w': w}}) AS b FROM
          (SELECT u.word, m.word AS w, levenshtein(u.b, m.b) AS d FROM (SELECT word, {_ONE_BYTE} FROM seen) u,
             (SELECT word, {_ONE_BYTE} FROM med) m WHERE u.word NOT IN (SELECT word FROM known))
          WHERE d < length(word) GROUP BY word)
        SELECT word, coalesce(b.w, word) AS corrected FROM seen LEFT JOIN best USING (word)""",
    "harmonised_extract": with_roles(("order_events",), "SELECT subject_id, item_id, min_from_anchor FROM order_events"),
    "mapped_items": with_roles(("part_concepts",), "SELECT DISTINCT item_id FROM part_concepts WHERE length(concept_id) > 4"),
    "criteria_subjects": with_roles(
        ("order_bag", "order_profile"),
        f"SELECT DISTINCT subject_id FROM order_bag JOIN order_profile USING (subject_id) WHERE unit IN {UNITS[:2]}",
    ),
    "original_item_ids": """SELECT 'd' || p_partkey AS doc_id, CASE WHEN p_size <= 25 THEN p_name ELSE 'd' || p_partkey END AS item_id
        FROM part""",
}
