"""Bags of events in long form: one row (subject, item, count)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.keys import clean_composite_key, phase_of
from ..session import stage
from .ranking import hash_chunk, number_rows

try:
    from pyspark.ml.linalg import VectorUDT
except ImportError:  # numpy missing: only the vector boundary needs it
    VectorUDT = None


def bag_of_events(events: DataFrame, drop_singletons: bool = False) -> DataFrame:
    """Count of each item per subject.

    ``drop_singletons`` removes subjects with exactly one distinct item.
    """
    bag = events.groupBy("subject_id", "item_id").agg(F.count(F.lit(1)).alias("cnt"))
    if not drop_singletons:
        return bag
    many = bag.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return bag.join(many.select("subject_id"), "subject_id", "left_semi")


def subjects_by_criteria(
    profile: DataFrame, subjects: DataFrame, criteria: dict[str, list[str]]
) -> DataFrame:
    """Subjects of ``subjects`` whose profile meets every criterion."""
    unknown = set(criteria) - {"unit"}
    if unknown:
        raise ValueError(f"unsupported criteria: {sorted(unknown)}")
    kept = profile
    for column, allowed in criteria.items():
        kept = kept.filter(F.col(column).isin(*allowed))
    return kept.select("subject_id").join(
        subjects.select("subject_id").distinct(), "subject_id", "left_semi"
    )


def unit_bags(
    events: DataFrame, profile: DataFrame, units: list[str], drop_singletons: bool = False
) -> DataFrame:
    """Bags of all given units in one table, with the subject's unit."""
    members = profile.filter(F.col("unit").isin(*units)).select("subject_id", "unit")
    return bag_of_events(events, drop_singletons).join(members, "subject_id")


def clean_bag_items(bag: DataFrame, phases: tuple[str, ...] = ("start",)) -> DataFrame:
    """Drop phase-tagged items of other phases; tidy the kept ones' ids.

    Counts are added up once more, as ids that differ in quotes become one.
    """
    phase = phase_of("item_id")
    tagged = phase.isin("start", "end")
    tidied = bag.filter(~tagged | phase.isin(*phases)).withColumn(
        "item_id",
        F.when(tagged, clean_composite_key("item_id", "all")).otherwise(F.col("item_id")),
    )
    keys = [c for c in bag.columns if c != "cnt"]
    return tidied.groupBy(*keys).agg(F.sum("cnt").alias("cnt")).select(*bag.columns)


def subject_spine(bag: DataFrame) -> DataFrame:
    """All subjects of a bag; carried along so empty rows are not lost."""
    return bag.select("subject_id").distinct()


def document_frequency(bag: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Subjects per item, within each group of ``by``.  Bag rows are unique, so a plain count is enough."""
    return (
        bag.filter(F.col("cnt") != 0)
        .groupBy(*by, "item_id")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def frequent_items(bag: DataFrame, threshold: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Bag restricted to items held by strictly more than ``threshold`` subjects (of their group)."""
    kept = document_frequency(bag, by).filter(F.col("df") > threshold)
    return bag.join(kept.drop("df"), [*by, "item_id"], "left_semi")


def filter_bag(
    bag: DataFrame,
    eligible: DataFrame,
    threshold: int = 5,
    items: DataFrame | None = None,
) -> DataFrame:
    """Eligible subjects first, then listed items, then frequent items."""
    kept = bag.join(eligible.select("subject_id"), "subject_id", "left_semi")
    if items is not None:
        kept = kept.join(items.select("item_id"), "item_id", "left_semi")
    return frequent_items(kept, threshold)


def concept_rollup(bag: DataFrame, item_concepts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per concept; every concept of an item gets its full count.

    Concepts without a count vanish.  Subjects left with none are kept by the
    spine, not here.
    """
    pairs = item_concepts.select("item_id", "concept_id").distinct()
    return (
        bag.join(pairs, "item_id")
        .groupBy(*by, "subject_id", "concept_id")
        .agg(F.sum("cnt").alias("cnt"))
        .filter(F.col("cnt") > 0)
        .withColumnRenamed("concept_id", "item_id")
    )


def concept_items(item_concepts: DataFrame) -> DataFrame:
    """Concept -> distinct items, in long form with the number of items."""
    pairs = item_concepts.select("concept_id", "item_id").distinct()
    sizes = pairs.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_items"))
    return pairs.join(sizes, "concept_id")


def mapped_item_ids(item_concepts: DataFrame) -> DataFrame:
    """Tidied ids of the items that have at least one concept."""
    return (
        item_concepts.filter(F.col("concept_id").isNotNull())
        .select(clean_composite_key("item_id").alias("item_id"))
        .distinct()
    )


def shared_items(train: DataFrame, test: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Items that occur in both bags (of their group)."""
    present, columns = F.col("cnt") > 0, [*by, "item_id"]
    return (
        train.filter(present)
        .select(*columns)
        .distinct()
        .join(test.filter(present).select(*columns), columns, "left_semi")
    )


def drop_subjects(bag: DataFrame, subjects: DataFrame) -> DataFrame:
    return bag.join(subjects.select("subject_id"), "subject_id", "left_anti")


def feature_index(items: DataFrame) -> DataFrame:
    """Dense 0-based index of distinct items, ordered by digest then id."""
    distinct = items.select("item_id").distinct().withColumn("_md5", F.md5("item_id"))
    numbered = number_rows(
        hash_chunk(distinct, "_md5"), [], [F.col("_md5"), F.col("item_id")], "row_num"
    )
    return numbered.select("item_id", (F.col("row_num") - 1).cast("int").alias("idx"))


def vector_struct(entries: Column, size: Column) -> Column:
    """Stored layout of a sparse vector from an array of (idx, weight)."""
    ordered = F.sort_array(entries)
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        size.cast("int").alias("size"),
        F.transform(ordered, lambda e: e["idx"]).alias("indices"),
        F.transform(ordered, lambda e: e["weight"]).alias("values"),
    )


def vector_rows(
    weights: DataFrame, index: DataFrame, spine: DataFrame, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One sparse ``features`` struct per spine row, empty rows included.

    ``weights`` holds (subject_id, item_id, weight).  A row never exceeds the
    number of features.
    """
    size = index.select(F.count(F.lit(1))).scalar()
    rows = (
        weights.join(index, "item_id")
        .groupBy("subject_id")
        .agg(
            F.collect_list(
                F.struct("idx", F.col("weight").cast("double").alias("weight"))
            ).alias("entries")
        )
    )
    empty = F.array().cast("array<struct<idx:int,weight:double>>")
    return (
        spine.select("subject_id", *keep)
        .join(rows, "subject_id", "left")
        .withColumn("size", size)
        .select(
            "subject_id",
            *keep,
            vector_struct(F.coalesce("entries", empty), F.col("size")).alias("features"),
        )
    )


def bag_vectors(
    weights: DataFrame, index: DataFrame, spine: DataFrame, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``vector_rows`` staged and read back with the ML vector type.

    The stored layout is that of a vector, so no Python code builds any.
    """
    table = vector_rows(weights, index, spine, keep)
    fields = [f for f in table.schema.fields if f.name != "features"]
    schema = T.StructType(fields + [T.StructField("features", VectorUDT())])
    return stage(table, "vectors", schema)
