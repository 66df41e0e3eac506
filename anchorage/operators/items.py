"""Item dictionaries and free-text values as items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import composite_key
from ..functions.text import normalise_value
from .ranking import hash_chunk, number_rows


def chart_dictionary(items: DataFrame) -> DataFrame:
    return items.select("item_id", "label")


def lab_dictionary(items: DataFrame) -> DataFrame:
    return items.select("item_id", "label", "fluid", "category")


def drug_dictionary(prescriptions: DataFrame) -> DataFrame:
    return prescriptions.select("drug_name", "route", F.lit("start").alias("start")).distinct()


def microbiology_dictionary(events: DataFrame) -> DataFrame:
    """Distinct composite ids with their composite labels."""
    return events.select(
        composite_key("spec_itemid", "org_itemid", "ab_itemid").alias("item_id"),
        composite_key("spec_type_desc", "org_name", "ab_name").alias("label"),
    ).distinct()


def distinct_item_values(events: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (item, label, value) of valued events.

    Values are reduced to distinct (item, value) before the label join.
    """
    pairs = events.select("item_id", "value").distinct()
    return pairs.join(items.select("item_id", "label"), "item_id").distinct()


def value_dictionary(item_values: DataFrame, squeeze: bool = False) -> DataFrame:
    """Index 1..k of each item's distinct normalised values.

    Blank and purely numeric values are skipped.  The index follows the
    digest of the value, which spreads an item's values evenly over tasks and
    does not depend on input order.
    """
    values = (
        item_values.select("item_id", normalise_value("value", squeeze).alias("value"))
        .filter(F.col("value").isNotNull())
        .distinct()
        .withColumn("_md5", F.md5("value"))
    )
    return number_rows(
        hash_chunk(values, "_md5"), ["item_id"], [F.col("_md5"), F.col("value")], "k"
    ).select("item_id", "value", F.col("k").cast("int").alias("k"))


def valued_items(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("item_id").distinct()


def value_labels(dictionary: DataFrame, items: DataFrame) -> DataFrame:
    """New item ids with descriptions ``label + ' ' + value``."""
    return dictionary.join(items.select("item_id", "label"), "item_id").select(
        F.concat_ws("_", "item_id", "k").alias("item_id"),
        F.concat_ws(" ", "label", "value").alias("label"),
        F.col("item_id").alias("original_id"),
    )


def tokenise_values(
    events: DataFrame, dictionary: DataFrame, squeeze: bool = False
) -> DataFrame:
    """Rewrite valued events to ``item_k``; others keep the plain item."""
    value = normalise_value("value", squeeze)
    lookup = dictionary.select("item_id", F.col("value").alias("_value"), "k")
    # rows without a usable value cannot match; kept out of the join, they do not meet in one task
    plain = events.filter(value.isNull())
    named = F.when(F.col("k").isNotNull(), F.concat_ws("_", "item_id", "k")).otherwise(F.col("item_id"))
    valued = events.withColumn("_value", value).filter(F.col("_value").isNotNull())
    indexed = valued.join(lookup, ["item_id", "_value"], "left").withColumn("item_id", named)
    return plain.unionByName(indexed.select(*events.columns))


def items_with_values(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Plain dictionary items plus the value items made from them.

    Items that have values stay in the list next to their value items.
    """
    plain = items.select("item_id", "label")
    extended = labels.join(
        items.select(F.col("item_id").alias("original_id")), "original_id", "left_semi"
    ).select("item_id", "label")
    return plain.unionByName(extended)


def chart_items(items: DataFrame, system: str | None = None) -> DataFrame:
    """Dictionary items not linked to microbiology, of one system if given."""
    kept = items.filter(~F.col("linksto").eqNullSafe("microbiologyevents"))
    return kept.filter(F.col("system") == system) if system else kept
