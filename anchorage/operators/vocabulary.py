"""Vocabularies, spelling correction and consolidation of item labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import composite_key
from ..functions.text import (
    LABEL_SYMBOLS,
    clean_label,
    staging_text,
    symbols_to_space,
    tokenised_description,
    whitespace_tokens,
    words,
)
from ..session import spread, stage
from . import nearest


def token_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """Occurrences of each word of two or more characters."""
    return (
        texts.select(F.explode(words(column, 2)).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def piece_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """Occurrences of each whitespace-separated piece of the cleaned label."""
    return (
        texts.select(F.explode(whitespace_tokens(clean_label(column))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def source_words(texts: DataFrame, column: str, clean: str = "label") -> DataFrame:
    """Distinct words one vocabulary source contributes.

    ``label`` cleans descriptions, ``item`` tokenises them first, ``code``
    only blanks symbols (dot and hash too) and lower-cases, ``plain`` takes
    one entry per row as it is.
    """
    text = {
        "label": clean_label(column),
        "item": clean_label(tokenised_description(column)),
        "code": F.lower(symbols_to_space(column, LABEL_SYMBOLS + ".", "#")),
        "plain": F.col(column),
    }[clean]
    if clean == "plain":
        return texts.select(text.alias("word")).filter(F.col("word").isNotNull()).distinct()
    return texts.select(F.explode(whitespace_tokens(text)).alias("word")).distinct()


def build_vocabulary(sources: list[DataFrame]) -> DataFrame:
    """Union of distinct words over the sources."""
    return reduce(DataFrame.unionByName, sources).distinct()


# --- spelling ---------------------------------------------------------------


KEY = ["len", "part", "piece"]
#: Edits that the index on pieces reaches.
NEAR = 2


def _parts(sized: DataFrame, k: int) -> DataFrame:
    """A row per piece of words ``len`` long: its number, where it begins and its size.

    A word may be ``k`` edits away, and fewer than it has characters; it is cut
    into one piece more.
    """
    allowed = F.least(F.lit(k), F.col("len") - 1)
    cut = lambda i: F.floor(i * F.col("len") / (F.col("allowed") + 1)).cast("int")
    return (
        sized.withColumn("allowed", allowed)
        .withColumn("part", F.explode(F.sequence(F.lit(0), "allowed")))
        .withColumn("begin", cut(F.col("part")))
        .withColumn("size", cut(F.col("part") + 1) - F.col("begin"))
    )


def _pieces(unknown: DataFrame, k: int) -> DataFrame:
    sized = unknown.withColumn("len", F.length("word"))
    piece = F.substring("word", F.col("begin") + 1, F.col("size"))
    return _parts(sized, k).select("word", "len", "part", piece.alias("piece"))


def _places(vocabulary: DataFrame, k: int) -> DataFrame:
    """Keys of all pieces that words of ``lengths`` could share with ``match``.

    With the edits split at a piece left whole, no more than its number lie before
    it and the rest after it, so it has moved by no more on either side.
    """
    longer = F.length("match") - F.col("len")
    sized = vocabulary.select("match", F.explode("lengths").alias("len")).where(
        F.abs(longer) <= F.least(F.lit(k), F.col("len") - 1)
    )
    begin, part, after = F.col("begin"), F.col("part"), F.col("allowed") - F.col("part")
    ranged = (
        _parts(sized, k)
        .withColumn("low", F.greatest(begin - part, begin + longer - after, F.lit(0)))
        .withColumn("high", F.least(begin + part, begin + longer + after, F.length("match") - F.col("size")))
        .where("low <= high")
    )
    return ranged.withColumn("place", F.explode(F.sequence("low", "high"))).select(
        "match", "len", "part", F.substring("match", F.col("place") + 1, F.col("size")).alias("piece")
    )


def candidate_pairs(unknown: DataFrame, vocabulary: DataFrame, k: int) -> DataFrame:
    """Every (word, match, distance) with edit distance at most ``k`` and below the word's length.

    Words of one character have none.  A word is cut into one piece more than edits are allowed, so one piece at
    least is left whole: words meet vocabulary words on a piece, by equality, and
    all pairs are found.  The distance is then checked exactly, before the pairs
    are shuffled.  Keys outgrow the words they come from, which the planner does
    not see, so the join is fixed.
    """
    w = unknown.select("word").filter(F.length("word") > 1).distinct()
    lengths = w.select(F.array_sort(F.collect_set(F.length("word")))).scalar()
    # many keys come of few words: spread these first
    cores = vocabulary.sparkSession.sparkContext.defaultParallelism
    v = vocabulary.select(F.col("word").alias("match")).distinct().repartition(cores, "match")
    places = _places(v.withColumn("lengths", lengths), k)
    return (
        _pieces(w, k)
        .join(places.hint("merge"), KEY)
        .select("word", "match", F.levenshtein("word", "match", k).alias("distance"))
        .filter((F.col("distance") >= 0) & (F.col("distance") < F.length("word")))
        .distinct()
    )


def best_matches(pairs: DataFrame) -> DataFrame:
    """(word, match): the nearest candidate strictly closer than the word is long.

    ``pairs`` may carry ``preferred`` (0 first); at equal distance the
    preferred list wins, then the alphabetically first word.
    """
    if "preferred" not in pairs.columns:
        pairs = pairs.withColumn("preferred", F.lit(0))
    return (
        pairs.filter(F.col("distance") < F.length("word"))
        .groupBy("word")
        .agg(F.min(F.struct("distance", "preferred", "match")).alias("b"))
        .select("word", "b.match", "b.distance")
    )


def nearest_words(unknown: DataFrame, vocabulary: DataFrame, k: int | None = None, block: int = nearest.BLOCK) -> DataFrame:
    """(word, match, distance): the best match of each word, at most ``k`` edits away if given.

    A vocabulary of several blocks is first met through an index on pieces, which finds what is
    ``NEAR`` edits away; only words without such a match go past the blocks.
    """
    rest = stage(spread(unknown.select("word").distinct(), "word"), "unknown")
    words = stage(vocabulary.select("word").distinct(), "vocabulary")
    if words.count() <= block:
        return nearest.nearest_by_blocks(rest, words, k, block)
    near = best_matches(candidate_pairs(rest, words, NEAR if k is None else min(NEAR, k)))
    looked = stage(rest.join(near, "word", "left"), "spelled")
    far = looked.filter(F.col("match").isNull()).select("word")
    return looked.filter(F.col("match").isNotNull()).unionByName(nearest.nearest_by_blocks(far, words, k, block))


def correct_spelling(
    observed: DataFrame,
    medical: DataFrame,
    general: DataFrame | None = None,
    k: int | None = None,
) -> DataFrame:
    """(word, corrected): known words stay, others go to their best match.

    ``observed``, ``medical`` and ``general`` hold distinct ``word`` rows.  A
    word of either list is known, and so is one whose upper-case form is in the
    medical list.  Suggestions come from the medical list, at any distance below
    the word's length (``k`` at most if given); words without any stay as they are.
    """
    seen = observed.select("word").distinct()
    shouted = medical.filter(F.upper("word") == F.col("word"))
    known = medical.select("word").unionByName(shouted.select(F.lower("word").alias("word")))
    if general is not None:
        known = known.unionByName(general.select("word"))
    unknown = seen.join(known, "word", "left_anti")
    best = nearest_words(unknown, medical, k).select("word", "match")
    return seen.join(best, "word", "left").select(
        "word", F.coalesce("match", "word").alias("corrected")
    )


# --- consolidation ----------------------------------------------------------


def replace_tokens(texts: DataFrame, mapping: DataFrame) -> DataFrame:
    """(item_id, label) with every whitespace token replaced via ``mapping``.

    ``mapping`` holds unique (word, corrected); unmapped tokens stay.  A row's
    tokens come back together in their order, so a group is one label.
    """
    tokens = texts.select(
        "item_id", F.posexplode(whitespace_tokens("label")).alias("pos", "word")
    )
    changed = mapping.filter(F.col("word") != F.col("corrected"))
    mapped = tokens.join(changed, "word", "left").select(
        "item_id", "pos", F.coalesce("corrected", "word").alias("word")
    )
    rebuilt = mapped.groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("t")
    )
    return (
        texts.select("item_id")
        .join(rebuilt, "item_id", "left")
        .select(
            "item_id",
            F.coalesce(
                F.array_join(F.transform("t", lambda t: t["word"]), " "), F.lit("")
            ).alias("label"),
        )
    )


def canonical_items(labels: DataFrame) -> DataFrame:
    """(item_id, label, canonical_id): smallest id, as text, per equal label.

    The label's digest is the group key, so long labels are not shuffled
    twice.
    """
    keyed = labels.withColumn("_key", F.sha2("label", 256))
    smallest = keyed.groupBy("_key").agg(
        F.min(F.col("item_id").cast("string")).alias("canonical_id")
    )
    return keyed.join(smallest, "_key").select(
        F.col("item_id").cast("string").alias("item_id"), "label", "canonical_id"
    )


def cleaned_items(items: DataFrame) -> DataFrame:
    """Items with a usable label, cleaned."""
    return items.filter(F.col("label") != "").select(
        "item_id", clean_label("label").alias("label")
    )


def consolidate_corrected(
    items: DataFrame, medical: DataFrame, general: DataFrame | None = None, k: int | None = None
) -> DataFrame:
    """Clean, spell-correct and consolidate the items of the older system.

    Gives (item_id, cleaned, label, canonical_id); the unique list is where
    item_id equals canonical_id.  Cleaned and corrected labels are stage
    tables, as each is read twice.
    """
    cleaned = stage(cleaned_items(items), "cleaned")
    observed = token_counts(cleaned, "label").select("word")
    corrected = stage(
        replace_tokens(cleaned, correct_spelling(observed, medical, general, k)), "corrected"
    )
    original = cleaned.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("label").alias("cleaned")
    )
    return original.join(canonical_items(corrected), "item_id")


def consolidate_clean(items: DataFrame) -> DataFrame:
    """Same for the newer system: cleaned labels, no spelling step."""
    spaced = cleaned_items(items).withColumn(
        "label", F.array_join(whitespace_tokens("label"), " ")
    )
    return canonical_items(stage(spaced, "cleaned")).withColumn("cleaned", F.col("label"))


def unique_items(consolidated: DataFrame) -> DataFrame:
    return consolidated.filter(F.col("item_id") == F.col("canonical_id"))


def corrections(consolidated: DataFrame) -> DataFrame:
    """(item_id, original, corrected): own text and that of the canonical item.

    Equal labels share their canonical item, so its label is the item's own.
    """
    return consolidated.select(
        "item_id", F.col("cleaned").alias("original"), F.col("label").alias("corrected")
    )


def drug_labels(drugs: DataFrame) -> DataFrame:
    """(item_id, label): key from the raw drug name, label from the cleaned."""
    return drugs.select(
        composite_key("drug_name", "route", "start").alias("item_id"),
        composite_key(clean_label("drug_name"), "route", "start").alias("label"),
    )


# --- staging ----------------------------------------------------------------


def staged_documents(
    microbiology: DataFrame,
    drugs: DataFrame,
    chart: DataFrame,
    lab: DataFrame,
) -> DataFrame:
    """One (item_id, family, text) row per item to annotate.

    A chart text has two lines, original and corrected description; only the
    first is stripped of symbols.
    """
    parts = [
        microbiology.select("item_id", F.lit("microbiology").alias("family"), staging_text("label").alias("text")),
        drugs.select("item_id", F.lit("drug").alias("family"), F.col("label").alias("text")),
        chart.select(
            "item_id",
            F.lit("chart").alias("family"),
            F.concat(staging_text("original"), F.lit("\n"), F.col("corrected")).alias("text"),
        ),
        lab.select(
            "item_id",
            F.lit("lab").alias("family"),
            staging_text(
                F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("label", "fluid", "category")])
            ).alias("text"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def drug_document_names(drugs: DataFrame) -> DataFrame:
    """(doc_id, item_id): file-safe document names for drug items.

    The name carries the item's digest, which needs no global numbering.
    """
    return drugs.select(
        F.concat(F.lit("prescription-"), F.substring(F.md5("item_id"), 1, 16)).alias("doc_id"),
        "item_id",
    ).distinct()
