"""Merkle trees over paragraphs and sections of documents.

A text is cut into paragraphs at line ends, a paragraph into leaves of up to
eight words with the white space around them.  A paragraph hashes its leaves; a
section is a run of paragraphs that ends where a paragraph's hash says so, so
that sections realign after an edit; the root hashes the sections.  Equal roots
mean equal texts; where roots differ, ``differing`` walks down the branches that
differ.

The fingerprint is a string: the root, a slash, and the leaves as eight hex
digits each, paragraphs divided by ``;`` and closed by ``|`` where a section
ends.  The likeness of two fingerprints is the Jaccard index of their leaves, and 1
where roots are equal.

A null text counts as the empty text, which has one paragraph without leaves.
Repeated rows have equal fingerprints.  An empty table gives no rows.  Columns
other than ``doc_id`` and ``text`` are not read.  All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import text_of

WORDS = 8
_BLANK = r"[\x20\x09\x0B-\x0D]"
#: All of a paragraph is covered: leading white space, words with what follows, or white space alone.
_LEAF = rf"{_BLANK}*+(?:[^\x20\x09-\x0D]++{_BLANK}*+){{1,{WORDS}}}|{_BLANK}++"
#: One paragraph in so many ends a section.
SECTION = 8


def tree(text: Column) -> Column:
    """Leaves of each paragraph: array<array<bigint>>."""
    paragraphs = F.split(text, "\n", -1)
    return F.transform(
        paragraphs, lambda p: F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda leaf: F.xxhash64(leaf))
    )


def _paragraph(leaves: Column) -> Column:
    return F.xxhash64(leaves, F.size(leaves))


def _closes(leaves: Column) -> Column:
    return F.pmod(_paragraph(leaves), F.lit(SECTION)) == 0


def sections(paragraphs: Column) -> Column:
    """Digest of each section, from the hashes of its paragraphs."""
    marked = F.transform(
        paragraphs, lambda p: F.concat(F.hex(_paragraph(p)), F.when(_closes(p), F.lit("|")).otherwise(F.lit(";")))
    )
    return F.transform(F.split(F.array_join(marked, ""), "\\|"), lambda s: F.sha2(s.cast("binary"), 256))


def root(paragraphs: Column) -> Column:
    return F.sha2(F.array_join(sections(paragraphs), "").cast("binary"), 256)


def _short(leaf: Column) -> Column:
    return F.lpad(F.lower(F.hex(leaf.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")


def fingerprint(paragraphs: Column) -> Column:
    shown = F.transform(
        paragraphs,
        lambda p: F.concat(F.array_join(F.transform(p, _short), ""), F.when(_closes(p), F.lit("|")).otherwise(F.lit(";"))),
    )
    return F.concat(F.substring(root(paragraphs), 1, 32), F.lit("/"), F.array_join(shown, ""))


def likeness(one: Column, other: Column) -> Column:
    """Jaccard index of the leaves of two trees."""
    a, b = (F.array_distinct(F.flatten(x)) for x in (one, other))
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def differing(one: Column, other: Column) -> Column:
    """Numbers (from 0) of the first tree's paragraphs that the second one lacks; none where roots are equal."""
    theirs = F.transform(other, _paragraph)
    lacking = F.transform(one, lambda p, i: F.when(~F.array_contains(theirs, _paragraph(p)), i))
    return F.when(root(one) == root(other), F.array().cast("array<int>")).otherwise(
        F.filter(lacking, lambda i: i.isNotNull())
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, root, fingerprint and section digests of each row."""
    return docs.select("doc_id", tree(text_of()).alias("_tree")).select(
        "doc_id", root(F.col("_tree")).alias("root"), fingerprint(F.col("_tree")).alias("fingerprint"),
        sections(F.col("_tree")).alias("sections"),
    )


def with_next(rows: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """Add next_<column>: the values of the next row in descending doc_id, after the last those of the first.

    Rows are dealt into ranges of doc_id, so texts are shuffled once; the first
    rows of each range are also sent to the range before it.  Rows that share an
    id follow each other in the order of a hash of the text.  Null ids come last.
    """
    cuts = rows.agg(
        F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("cuts")
    ).first()["cuts"]  # parts - 1 numbers
    cuts = sorted(set(cuts or []), reverse=True)
    part = _interval(F.col("doc_id"), cuts)
    placed = rows.withColumn("_part", part)
    # the first id of each range, one row per range
    heads = placed.groupBy("_part").agg(F.max("doc_id").alias("head")).orderBy("_part").collect()
    before = {r["_part"]: heads[i - 1]["_part"] for i, r in enumerate(heads)}
    guests = F.array(
        *[
            F.struct(F.lit(r["_part"]).alias("part"), F.lit(r["head"]).cast("long").alias("head"), F.lit(before[r["_part"]]).alias("before"))
            for r in heads
        ]
    ).cast("array<struct<part:int,head:bigint,before:int>>")
    home = F.struct(F.col("_part").alias("part"), F.lit(0).alias("guest"))
    visit = F.transform(
        F.filter(guests, lambda g: (g["part"] == F.col("_part")) & g["head"].eqNullSafe(F.col("doc_id"))),
        lambda g: F.struct(g["before"].alias("part"), F.lit(1).alias("guest")),
    )
    sent = placed.withColumn("_at", F.explode(F.concat(F.array(home), visit)))
    order = Window.partitionBy("_at.part").orderBy("_at.guest", F.col("doc_id").desc_nulls_last(), "_tie")
    return (
        sent.withColumn("_tie", F.xxhash64("text"))
        .select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
        .where("_at.guest = 0")
        .drop("_part", "_at", "_tie")
    )


def _interval(value: Column, cuts: list[int]) -> Column:
    """How many of the descending ``cuts`` are above ``value``, by halving; null after all."""
    steps = max(1, len(cuts)).bit_length()
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        above = F.get(bounds, middle) > value
        going = state["low"] < state["high"]
        return F.struct(
            F.when(going & above, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(going & ~above, middle).otherwise(state["high"]).alias("high"),
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["low"]
    return F.when(value.isNull(), F.lit(len(cuts) + 1)).otherwise(found)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document against itself with its last third replaced by the start of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("tree", tree(F.col("text")))
    paired = with_next(rows, ["text", "tree"], parts)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    told = paired.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "tree", "next_tree")
    told = told.withColumn("edited_tree", tree(F.col("edited")))
    print_of, edited_print, next_root = (
        fingerprint(F.col("tree")), fingerprint(F.col("edited_tree")), root(F.col("next_tree")),
    )
    return told.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        print_of.alias("fingerprint"),
        edited_print.alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
        F.size(differing(F.col("tree"), F.col("edited_tree"))).alias("n_differing"),
        (F.substring(print_of, 1, 32) == F.substring(next_root, 1, 32)).alias("equals_next"),
    )
