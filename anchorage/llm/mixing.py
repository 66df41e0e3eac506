"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source has a target in words.  Its documents are permuted by a hash and cut
into blocks; the mix walks through the permuted blocks until the target is
met, more than once if the target is larger than the source, so every epoch's
blocks are disjoint.  A tree splits the blocks that the mix draws among output
shards: each node hands its left half an exact number of blocks, and how many
of them come from each source is drawn from the multivariate hypergeometric
distribution.  A shard then shuffles what it got by a hash.

The last document of a source is taken in part, so that its words meet the
target exactly.  Null and empty texts have no words and are never drawn; a null
source comes last in the order of sources.  Repeated rows are drawn each for
itself.  An empty table gives no rows.  Only ``doc_id``, ``source``
and ``text`` are read; ``mix`` hands on all columns.

All of it is DataFrame operations.  What is held per source or per (node,
source) is small: one row per source, and one number per source and shard.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, row_id, stage, text_of

SEED = "mixing"
#: Words of a block, words of an output shard, and blocks summed at once.
BLOCK_WORDS, SHARD_WORDS, GROUP = 20_000, 5_000_000, 1024
#: Most times that a document is used.
REPEATS = 3


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a place in the permutation of its source."""
    digest = F.md5(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string")))
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("place"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target and quota (the target in whole words).

    Sources by code point, null last, weigh 1, 2, 3, repeating.  A source whose
    share reaches ``REPEATS`` times its size stops there; sources sorted by cap
    over weight stop in that order, so one pass of running sums finds the level.
    """
    each = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * REPEATS
    first_to_stop = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = first_to_stop.rowsBetween(Window.unboundedPreceding, -1)
    rest = first_to_stop.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = each.select("source", "source_size", weight.alias("weight"), cap.alias("cap")).select(
        "*",
        F.row_number().over(first_to_stop).alias("turn"),
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / F.sum("weight").over(rest)
        ).alias("level"),
    )
    # the level of the first source that does not stop holds for it and all after it
    going_on = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("turn", "level"))
    open_level = F.min(going_on).over(everything)["level"]
    shared = level.withColumn("level", open_level)
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return shared.select(
        "source", "source_size", target.alias("target"), F.least("cap", F.floor(target + 0.5)).alias("quota")
    )


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, whose error is below 1e-12."""
    m = n + 8.0
    series = 1 / (12 * m) - 1 / (360 * m * m * m) + 1 / (1260 * m * m * m * m * m)
    below = functools.reduce(lambda a, k: a * (n + float(k)), range(2, 9), n + 1.0)
    return m * F.log(m) - m + 0.5 * F.log(2 * math.pi * m) + series - F.log(below)


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``marked`` are among ``drawn`` of ``total``, by inversion of the distribution.

    Sums the probabilities from 14 standard deviations below the mean, or the
    least possible value, until they reach ``uniform``.
    """
    given = F.struct(
        total.cast("double").alias("n"), marked.cast("double").alias("k"), drawn.cast("double").alias("d"),
        uniform.alias("uniform"),
    )
    return _let(given, lambda g: _let(_bounds(g), lambda b: _invert(g, b)))


def _bounds(g: Column) -> Column:
    n, k, d = g["n"], g["k"], g["d"]
    mean = F.when(n > 0, k * d / n).otherwise(0.0)
    width = F.ceil(14 * F.sqrt(F.greatest(mean * (1 - F.when(n > 0, d / n).otherwise(0.0)), F.lit(0.0))) + 14)
    low = F.greatest(F.lit(0.0), d + k - n, F.floor(mean) - width)
    return F.struct(low.alias("low"), F.least(k, d, F.ceil(mean) + width).alias("high"))


def _invert(g: Column, b: Column) -> Column:
    n, k, d, low = g["n"], g["k"], g["d"], b["low"]
    up = [k, n - k, d, n - d]
    down = [n, low, k - low, d - low, n - k - d + low]
    logs = F.transform(F.array(*up, *down), _log_factorial)
    signed = F.zip_with(logs, F.array(*[F.lit(1.0)] * len(up), *[F.lit(-1.0)] * len(down)), lambda x, sign: x * sign)
    first = F.exp(F.aggregate(signed, F.lit(0.0), lambda x, y: x + y))

    def step(state: Column, x: Column) -> Column:
        """state: sum so far, probability of x, value once found."""
        y = x.cast("double")
        reached = state["sum"] + state["p"]
        ratio = (k - y) * (d - y) / ((y + 1) * (n - k - d + y + 1))
        return F.struct(
            reached.alias("sum"),
            (state["p"] * F.greatest(ratio, F.lit(0.0))).alias("p"),
            F.when(state["value"].isNull() & (reached >= g["uniform"]), x).otherwise(state["value"]).alias("value"),
        )

    start = F.struct(F.lit(0.0).alias("sum"), first.alias("p"), F.lit(None).cast("long").alias("value"))
    low, high = low.cast("long"), b["high"].cast("long")
    return F.coalesce(F.aggregate(F.sequence(low, high), start, step)["value"], high)


def _right(df: DataFrame, *keys: str) -> DataFrame:
    """The right side of a join, with its keys out of the way."""
    return df.withColumnsRenamed({k: f"_{k}" for k in keys})


def _same(*keys: str) -> Column:
    """Equal keys, null with null."""
    return functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))


def split(draws: DataFrame, shards: int) -> DataFrame:
    """source, shard, first, last: which of a source's draws go to which shard.

    ``draws``: source, draws.  Every level of the tree turns a node into two;
    a node is a row with the blocks it has of each source.
    """
    nodes = draws.agg(
        F.sort_array(F.collect_list(F.struct(F.col("source"), F.col("draws").alias("n")))).alias("has"),
        F.sum("draws").alias("blocks"),
    ).select(F.lit(0).alias("low"), F.lit(shards).alias("high"), F.col("has"), F.coalesce("blocks", F.lit(0)).alias("blocks"))
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        half = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        whole = F.col("high") - F.col("low")
        left_blocks = F.floor(F.col("blocks") * (half - F.col("low")) / whole)

        def draw(state: Column, source: Column) -> Column:
            """Left blocks source by source: each draw is from what is left of node and half."""
            uniform = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("low"), F.col("high"), source["source"]), 11) / float(1 << 53)
            got = F.when(source["n"] == 0, F.lit(0).cast("long")).otherwise(
                hypergeometric(state["blocks"], source["n"], state["wanted"], uniform)
            )
            return F.struct(
                (state["blocks"] - source["n"]).alias("blocks"),
                (state["wanted"] - got).alias("wanted"),
                F.concat(state["taken"], F.array(got)).alias("taken"),
            )

        empty = F.array().cast("array<bigint>")
        start = F.struct(F.col("blocks").alias("blocks"), F.col("left_blocks").alias("wanted"), empty.alias("taken"))
        split_here = (
            nodes.withColumn("half", half)
            .withColumn("left_blocks", left_blocks)
            .withColumn("taken", F.when(whole > 1, F.aggregate("has", start, draw)["taken"]))
        )
        left = F.zip_with("has", "taken", lambda s, t: F.struct(s["source"].alias("source"), t.alias("n")))
        right = F.zip_with("has", "taken", lambda s, t: F.struct(s["source"].alias("source"), (s["n"] - t).alias("n")))

        def node(low: Column, high: Column, has: Column, blocks: Column) -> Column:
            return F.struct(low.alias("low"), high.alias("high"), has.alias("has"), blocks.cast("long").alias("blocks"))

        children = F.when(
            whole > 1,
            F.array(
                node(F.col("low"), F.col("half"), left, F.col("left_blocks")),
                node(F.col("half"), F.col("high"), right, F.col("blocks") - F.col("left_blocks")),
            ),
        ).otherwise(F.array(node(F.col("low"), F.col("high"), F.col("has"), F.col("blocks"))))
        # at most as many rows as shards; stored, so that plans do not nest
        nodes = stage(split_here.select(F.explode(children).alias("c")).select("c.*"), "tree")
    # a source's draws are dealt to shards in a row
    quotas = nodes.select(F.col("low").alias("shard"), F.explode("has").alias("s")).select("shard", "s.source", "s.n")
    upto = Window.partitionBy("source").orderBy("shard")
    return (
        quotas.withColumn("last", F.sum("n").over(upto) - 1)
        .where("n > 0")
        .select("source", "shard", (F.col("last") - F.col("n") + 1).alias("first"), "last")
    )


def plan(docs: DataFrame) -> DataFrame:
    """Each document with its source's size and target and the draws the mix makes of it.

    draws: an array of (epoch, shard, words), one entry for each time the
    document is used.
    """
    rows = stage(sizes(docs), "sizes")
    goal = stage(targets(rows), "targets")  # a row per source
    blocks_of = F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.lit(1))
    goal = goal.withColumn("blocks", blocks_of)
    total = goal.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, math.ceil(total / SHARD_WORDS))
    # a shift, so that the product stays within 64 bits
    block = F.shiftright(F.shiftright(F.col("place"), 30) * F.col("blocks"), 30)
    placed = rows.join(_right(goal, "source"), _same("source")).drop("_source").withColumn("block", block)
    starts = _block_starts(placed)
    drawn = _draws(starts, shards)
    inside = Window.partitionBy("source", "block").orderBy("place", "doc_id", "size")
    laid = placed.withColumn("_inside", F.sum("size").over(inside) - F.col("size"))
    met = laid.join(_right(drawn, "source", "block"), _same("source", "block"), "left").withColumn(
        "_first", F.coalesce("start", F.lit(0)) + F.col("_inside")
    )
    words = lambda e: F.greatest(
        F.lit(0), F.least(F.col("size"), F.col("quota") - e["epoch"] * F.col("source_size") - F.col("_first"))
    )
    entries = F.transform(
        F.coalesce("shards", F.array().cast("array<struct<epoch:bigint,shard:int>>")),
        lambda e: F.struct(e["epoch"].alias("epoch"), e["shard"].alias("shard"), words(e).cast("long").alias("words")),
    )
    return met.select(
        "doc_id", "source", "size", "source_size", "target", F.filter(entries, lambda e: e["words"] > 0).alias("draws")
    )


def _block_starts(placed: DataFrame) -> DataFrame:
    """Words before each block of its source, in two levels: groups of blocks, then blocks."""
    keys = ["source", "block", "source_size", "quota", "blocks"]
    blocks = placed.groupBy(*keys).agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("block") / GROUP))
    group_before = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        blocks.groupBy("source", "group")
        .agg(F.sum("words").alias("n"))
        .select("source", "group", F.coalesce(F.sum("n").over(group_before), F.lit(0)).alias("before"))
    )
    before = Window.partitionBy("source", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.withColumn("_inside", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(_right(groups, "source", "group"), _same("source", "group"))
        .select(*keys, "words", (F.col("before") + F.col("_inside")).alias("start"))
    )


def _draws(starts: DataFrame, shards: int) -> DataFrame:
    """Each block with its start and the (epoch, shard) of its draws; its n-th draw is the tree's n-th of its source."""
    epochs = F.sequence(F.lit(0).cast("long"), F.floor(F.col("quota") / F.greatest("source_size", F.lit(1))))
    uses = (
        starts.where("words > 0")
        .select("source", "block", "start", "quota", "source_size", F.explode(epochs).alias("epoch"))
        .where(F.col("epoch") * F.col("source_size") + F.col("start") < F.col("quota"))
    )
    uses = stage(uses.select("source", "block", "start", "epoch"), "draws")
    tree = split(uses.groupBy("source").agg(F.count(F.lit(1)).alias("draws")), shards)
    numbered = _numbered(uses)
    dealt = tree.select("source", "shard", F.explode(F.sequence("first", "last")).alias("draw"))
    return (
        numbered.join(_right(dealt, "source", "draw"), _same("source", "draw"))
        .groupBy("source", "block", "start")
        .agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("shards"))
    )


def _numbered(uses: DataFrame) -> DataFrame:
    """Number the draws of a source from 0 by epoch and block, group by group."""
    dealt = uses.withColumn("group", F.floor(F.col("block") / GROUP))
    before = Window.partitionBy("source").orderBy("epoch", "group").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        dealt.groupBy("source", "epoch", "group")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("source", "epoch", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("source", "epoch", "group").orderBy("block")
    rows = dealt.withColumn("_inside", F.row_number().over(inside) - 1)
    return rows.join(_right(groups, "source", "epoch", "group"), _same("source", "epoch", "group")).select(
        "source", "block", "start", "epoch", (F.col("before") + F.col("_inside")).alias("draw")
    )


def mix(docs: DataFrame) -> DataFrame:
    """One row per draw with all columns of ``docs``, shuffled within shards; a partly drawn text ends early."""
    # the row goes along as one value, so no name of its columns meets one made here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_id().alias("id"), "text")
    # a list per id: rows that share an id meet their plans in the order of size; rows without one are told apart by text
    plans = (
        plan(docs.select(row_id().alias("doc_id"), "text", "source"))
        .groupBy(F.col("doc_id").alias("plan_id"))
        .agg(F.sort_array(F.collect_list(F.struct("size", "draws"))).alias("plans"))
    )
    word = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(word, F.lit(1), F.col("draw.words").cast("int")), "")
    whole = F.col("draw.words") == F.col("size")
    order = Window.partitionBy("id").orderBy("size", "text")
    drawn = (
        rows.join(plans, F.col("id") == F.col("plan_id"))
        .withColumn("size", F.regexp_count(text_of(), F.lit(WORD)))
        .withColumn("own", F.element_at("plans", F.row_number().over(order)))
        .withColumn("draw", F.explode("own.draws"))
        .withColumn("taken", F.when(whole, F.col("text")).otherwise(cut))
    )
    changed = {"text": F.col("taken")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length("taken")).cast(docs.schema["n_chars"].dataType)
    return (
        drawn.withColumn("turn", F.xxhash64(F.lit(SEED), "id", "draw.epoch"))
        .repartition("draw.shard")
        .sortWithinPartitions("draw.shard", "turn")
        .select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    )
