"""Concept spans from annotator XML documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.keys import document_item_id

# Element and attribute names of the annotation format.
ARRAY_ELEMENT = "uima.cas.FSArray"
CONCEPT_ELEMENT = "org.apache.ctakes.typesystem.type.refsem.UmlsConcept"
REFERENCE = "_ref_ontologyConceptArr"

_LINKS = (
    f"`{ARRAY_ELEMENT}` array<struct<`@_id`: string, i: array<string>>>, "
    f"`{CONCEPT_ELEMENT}` array<struct<`@_id`: string, `@cui`: string>>"
)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, xml) of the plain files of a folder, hidden ones skipped."""
    return spark.read.text(folder, wholetext=True).select(
        document_item_id(F.input_file_name()).alias("doc_id"), F.col("value").alias("xml")
    )


def _by_id(entries: Column, ids: Column, values: Column) -> Column:
    """Map from an id to the array of its values; null where an id is told twice."""
    alone = F.size(F.array_distinct(ids)) == F.size(entries)
    pairs = F.arrays_zip(ids.alias("id"), F.transform(values, lambda v: F.array(v)).alias("v"))
    return F.when(alone, F.map_from_entries(pairs))


def concept_spans(documents: DataFrame) -> DataFrame:
    """Distinct (doc_id, concept_id, begin, end) of each document, a row each.

    A concept belongs to an array by its id, and an annotated element points
    to the array; both links are resolved inside the document's row, by maps,
    so no row meets another.  Ids that are told twice are looked up one by one.  Elements
    without an offset are left out: the lists of attributes are zipped by place,
    so each of them lists the same elements.
    """
    options = {"attributePrefix": "@", "rowTag": "CAS"}
    parsed = documents.select(
        "doc_id",
        F.from_xml("xml", _LINKS, options).alias("links"),
        *[
            F.xpath("xml", F.lit(f"/*/*[@{REFERENCE} and @begin and @end]/@{a}")).alias(n)
            for a, n in (("begin", "b"), ("end", "e"), (REFERENCE, "r"))
        ],
    )
    none = F.array().cast("array<string>")
    concepts = F.coalesce(F.col(f"links.`{CONCEPT_ELEMENT}`"), F.expr("cast(array() as array<struct<`@_id`: string, `@cui`: string>>)"))
    arrays = F.coalesce(F.col(f"links.`{ARRAY_ELEMENT}`"), F.expr("cast(array() as array<struct<`@_id`: string, i: array<string>>>)"))
    parsed = parsed.select("doc_id", concepts.alias("concepts"), arrays.alias("arrays"), F.arrays_zip("b", "e", "r").alias("spans"))
    mapped = parsed.withColumns(
        {
            "by_concept": _by_id(F.col("concepts"), F.col("concepts.@_id"), F.col("concepts.@cui")),
            "by_array": _by_id(F.col("arrays"), F.col("arrays.@_id"), F.col("arrays.i")),
        }
    )

    def listed(entries: str, field: str, wanted: Column) -> Column:
        return F.transform(F.filter(entries, lambda e: e["@_id"] == wanted), lambda e: e[field])

    def names(member: Column) -> Column:
        looked = F.coalesce(F.try_element_at("by_concept", member), none)
        return F.when(F.col("by_concept").isNotNull(), looked).otherwise(listed("concepts", "@cui", member))

    def members(ref: Column) -> Column:
        empty = F.expr("cast(array() as array<array<string>>)")
        looked = F.coalesce(F.try_element_at("by_array", ref), empty)
        lists = F.when(F.col("by_array").isNotNull(), looked).otherwise(listed("arrays", "i", ref))
        return F.array_distinct(F.flatten(F.transform(lists, lambda x: F.coalesce(x, none))))

    def found(span: Column) -> Column:
        held = F.array_distinct(F.flatten(F.transform(members(span["r"]), names)))
        return F.transform(
            held, lambda c: F.struct(c.alias("concept_id"), span["b"].cast("int").alias("begin"), span["e"].cast("int").alias("end"))
        )

    spans = F.array_distinct(F.flatten(F.transform("spans", found)))
    return mapped.select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.concept_id", "s.begin", "s.end")
