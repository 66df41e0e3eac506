"""Draws of stratified bootstraps, packed.

A replicate draws as many rows of each class as it has; which one the i-th draw takes is the digest of
``seed:rep:cls:i`` modulo the class size.  Digests are worked out many at a time.

Groups of up to ``HERE`` rows are drawn where the ranks of all their rows are: a task takes some replicates of as many
groups as ``TOGETHER`` allows, which share the digests, and nothing of a draw travels.  Draws of larger groups
meet their rows a block of ``BLOCK`` row numbers at a time, and then the draws of the other class a
block of as many score ranks at a time: two shuffles of two bytes a draw, and no task
holds more than a block of places and some replicates' draws from it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..session import stage
from .ranking import _CHUNK

#: Row numbers and ranks of a block: a place in it takes two bytes.
BLOCK = 1 << 16
#: Draws that a task makes, and that meet in a task, at once.
MADE = 1 << 22
#: Rows of a group whose replicates are drawn in one task each, and rows of the groups that share a task.
HERE, TOGETHER = 1 << 20, 1 << 23
#: Digests worked out at once.
AT_ONCE = 1 << 15

_TURNS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_SINES = [int(abs(np.sin(i + 1.0)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_head(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """First 52 bits of the MD5 of ``n`` one-block messages: 16 little-endian words, a number where all have the same."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, f)
            f |= b
            f ^= c
        f += a
        same = isinstance(words[g], int)
        f += np.uint32((_SINES[i] + (words[g] if same else 0)) & 0xFFFFFFFF)
        if not same:
            f += words[g]
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), t)
        f >>= np.uint32(32 - turn)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    head = (a + np.uint32(_START[0])).byteswap().astype(np.uint64)
    return ((head << np.uint64(20)) | ((b + np.uint32(_START[1])).byteswap() >> np.uint32(12))).astype(np.int64)


def digest_heads(prefix: str, first: int, count: int) -> np.ndarray:
    """The first 13 hex digits of md5(prefix + i) for ``count`` numbers i from ``first``."""
    lead = prefix.encode()
    if len(lead) + 20 > 55:
        raise ValueError("prefix must leave room for a number in one block")
    out = np.empty(count, np.int64)
    at = first
    while at < first + count:
        # numbers of as many digits
        digits = len(str(at))
        end = min(first + count, 10**digits, at + AT_ONCE)
        n, size = end - at, len(lead) + digits
        plain = lead + b"0" * digits + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little")
        words: list[np.ndarray | int] = [int.from_bytes(plain[i : i + 4], "little") for i in range(0, 64, 4)]
        for k in range(digits):
            place, scale = len(lead) + k, 10 ** (digits - 1 - k)
            low, high = at // scale, (end - 1) // scale
            # each digit in runs of equal ones
            edges = np.minimum(np.arange(low, high + 2) * scale, end)
            edges[0] = at
            digit = np.repeat((np.arange(low, high + 1) % 10).astype(np.uint32) << np.uint32(8 * (place % 4)), np.diff(edges))
            words[place // 4] = digit + (np.uint32(words[place // 4]) if isinstance(words[place // 4], int) else words[place // 4])
        out[at - first : end - first] = _md5_head(words, n)
        at = end
    return out


def _runs(block: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of each run in a sorted array."""
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: block.size])
    return [(int(block[a]), int(a), int(b)) for a, b in zip(cuts, [*cuts[1:], block.size])]


def _packed(places: np.ndarray) -> list[tuple[int, bytes]]:
    """Block and places in it, of two bytes each, of numbers from 0."""
    places = np.sort(places)
    return [(k, (places[a:b] - k * BLOCK).astype("<u2").tobytes()) for k, a, b in _runs(places // BLOCK)]


def _made(columns: Sequence[Sequence], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def drawn_chunks(placed: DataFrame, by: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """by, rep, chunk of scores, and wins, pos, neg among the draws from it.

    ``placed``: by, cls (0 or 1), slot (from 1 in its class) and rank (from 1 among the distinct scores of its group).
    """
    by = list(by)
    sizes = stage(placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    large, small = sizes.where(F.col("_n") > HERE), sizes.where(F.col("_n") <= HERE)

    def rows_of(groups: DataFrame, others: DataFrame) -> DataFrame:
        if others.isEmpty():
            return placed
        same = [F.col(f"p.{c}").eqNullSafe(F.col(f"g.{c}")) for c in by]
        return placed.alias("p").join(F.broadcast(groups.alias("g")), same, "left_semi")

    parts = []
    if not large.isEmpty():
        parts.append(_drawn_apart(rows_of(large, small), by, replicates, seed))
    if not parts or not small.isEmpty():
        parts.append(_drawn_here(rows_of(small, large), small, by, replicates, seed))
    return reduce(DataFrame.unionByName, parts)


def _drawn_here(placed: DataFrame, sizes: DataFrame, by: list[str], replicates: int, seed: int) -> DataFrame:
    """``drawn_chunks`` with one chunk a group, each replicate in one task."""
    spark = placed.sparkSession
    ranked = F.array_sort(F.collect_list(F.struct("slot", "rank")))
    sides = placed.groupBy(*by, "cls").agg(F.transform(ranked, lambda e: e["rank"].cast("int")).alias("ranks"))
    # a row a group and class: both lie together, in bundles of so many rows
    before = F.coalesce(F.sum("_n").over(W.orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) if by else F.lit(0)
    bundles = sizes.withColumn("_bundle", F.floor(before / TOGETHER)).drop("_n")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    held = sides.alias("s").join(F.broadcast(bundles.alias("b")), same) if by else sides.alias("s").crossJoin(bundles)
    held = stage(held.select(*[f"s.{c}" for c in by], "cls", "ranks", "_bundle"), "ranks")
    tasks = max(1, min(replicates, 4 * spark.sparkContext.defaultParallelism))
    step = -(-replicates // tasks)
    made = T.StructType([*(held.schema[c] for c in by), *T.StructType.fromDDL(f"rep long, {_CHUNK} long, wins double, pos long, neg long").fields])
    schema = _arrow(made)

    def draw(table: pa.Table) -> pa.Table:
        groups: dict[tuple, list[np.ndarray]] = {}
        none = np.zeros(0, np.int32)
        ranks = table.column("ranks").combine_chunks()
        for i, (*own, cls) in enumerate(zip(*(table.column(c).to_pylist() for c in (*by, "cls")))):
            groups.setdefault(tuple(own), [none, none])[cls] = ranks[i].values.to_numpy(zero_copy_only=False)
        first, columns = table.column("_first")[0].as_py(), [[] for _ in schema]
        longest = [max(side[cls].size for side in groups.values()) for cls in (0, 1)]
        for rep in range(first, min(replicates, first + step)):
            heads = [digest_heads(f"{seed}:{rep}:{cls}:", 1, n) for cls, n in enumerate(longest)]
            places: dict[tuple[int, int], np.ndarray] = {}
            for own, sides in groups.items():
                drawn = []
                for cls, side in enumerate(sides):
                    n = side.size
                    if (cls, n) not in places:
                        places[cls, n] = heads[cls][:n] % max(1, n)
                    drawn.append(side[places[cls, n]])
                top = max((int(side.max()) for side in sides if side.size), default=0)
                neg = np.bincount(drawn[0], minlength=top + 1)
                wins = (2 * np.cumsum(neg) - neg)[drawn[1]].sum() / 2.0
                for c, v in zip(columns, (*own, rep, 0, float(wins), drawn[1].size, drawn[0].size)):
                    c.append(v)
        return _made(columns, schema)

    turns = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(step)))
    dealt = held.withColumn("_first", turns).repartition(4 * tasks, "_bundle", "_first")
    return stage(dealt.groupBy("_bundle", "_first").applyInArrow(draw, made), "drawn")


def _drawn_apart(placed: DataFrame, by: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """``drawn_chunks`` of groups that no task holds."""
    by, spark = list(by), placed.sparkSession
    keys = [placed.schema[c] for c in by]
    sizes = placed.groupBy(*by, "cls").agg(F.max("slot").alias("n"))
    # replicates of a small class are made together, a large class in several pieces
    step = F.least(F.lit(MADE), "n")
    together = F.greatest(F.lit(1), F.least(F.lit(replicates), F.floor(F.lit(MADE) / F.col("n"))))
    work = (
        sizes.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n") - 1, step)))
        .withColumn("reps", together)
        .withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"), "reps")))
    )
    parts = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    drawn_as = T.StructType([*keys, *T.StructType.fromDDL("cls int, block long, rep long, data binary").fields])
    drawn_schema = _arrow(drawn_as)

    def draw(batches):
        for batch in batches:
            for r in batch.to_pylist():
                columns = [[] for _ in drawn_schema]
                count = min(MADE, r["n"] - r["first"])
                for rep in range(r["rep"], min(replicates, r["rep"] + r["reps"])):
                    own = digest_heads(f"{seed}:{rep}:{r['cls']}:", r["first"] + 1, count) % r["n"]
                    for block, data in _packed(own):
                        for c, v in zip(columns, (*(r[k] for k in by), r["cls"], block, rep, data)):
                            c.append(v)
                yield from _made(columns, drawn_schema).to_batches()

    drawn = work.repartition(parts, *by, "cls", "first", "rep").mapInArrow(draw, drawn_as)
    # a block's replicates meet its places in several groups, so that small groups are not tasks of their own
    most = max(1, MADE // BLOCK)
    drawn = drawn.withColumn("part", F.floor(F.col("rep") / most))
    blocks = (
        placed.withColumn("block", F.floor((F.col("slot") - 1) / BLOCK))
        .groupBy(*by, "cls", "block")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "rank"))).alias("places"))
        .select(*by, "cls", "block", F.col("places.rank").alias("ranks"))
    )
    wide = -(-replicates // most)
    blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long"))))
    ranked_as = T.StructType([*keys, *T.StructType.fromDDL(f"cls int, {_CHUNK} long, rep long, data binary").fields])
    ranked_schema = _arrow(ranked_as)

    def rank(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ranks = right.column("ranks").combine_chunks().values.to_numpy(zero_copy_only=False)
        columns = [[] for _ in ranked_schema]
        own = tuple(k.as_py() for k in key)[: len(by) + 1]
        held: dict[int, list[bytes]] = {}
        for rep, data in zip(left.column("rep").to_pylist(), left.column("data").to_pylist()):
            held.setdefault(rep, []).append(data)
        for rep, data in held.items():
            places = ranks[np.frombuffer(b"".join(data), "<u2")] - 1
            for chunk, packed in _packed(places):
                for c, v in zip(columns, (*own, chunk, rep, packed)):
                    c.append(v)
        return _made(columns, ranked_schema)

    meet = [*by, "cls", "block", "part"]
    ranked = drawn.groupBy(*meet).cogroup(blocks.groupBy(*meet)).applyInArrow(rank, ranked_as)
    told_as = T.StructType([*keys, *T.StructType.fromDDL(f"rep long, {_CHUNK} long, wins double, pos long, neg long").fields])
    told_schema = _arrow(told_as)

    def tally(table: pa.Table) -> pa.Table:
        columns = [[] for _ in told_schema]
        own = [table.column(k)[0].as_py() for k in by]
        chunk = table.column(_CHUNK)[0].as_py()
        held: dict[int, tuple[list[bytes], list[bytes]]] = {}
        for rep, cls, data in zip(*(table.column(c).to_pylist() for c in ("rep", "cls", "data"))):
            held.setdefault(rep, ([], []))[cls].append(data)
        for rep, sides in held.items():
            neg, pos = (np.bincount(np.frombuffer(b"".join(d), "<u2"), minlength=BLOCK) for d in sides)
            wins = float((pos * (np.cumsum(neg) - neg / 2.0)).sum())
            for c, v in zip(columns, (*own, rep, chunk, wins, int(pos.sum()), int(neg.sum()))):
                c.append(v)
        return _made(columns, told_schema)

    told = ranked.withColumn("part", F.floor(F.col("rep") / most)).groupBy(*by, _CHUNK, "part").applyInArrow(tally, told_as)
    return stage(told, "drawn")
