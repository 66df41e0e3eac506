"""Byte-balanced shards by Karmarkar-Karp differencing.

Rows with equal texts are a group that stays whole.  Groups with a share of
1 / ``LARGE`` of all bytes or more are listed, so at most ``LARGE`` of them;
the others are summed in ``POOLS`` pools by a hash.  Differencing runs over
these items alone, however many rows there are, and its spread is far below a
pool.  Shards are as near to equal as the largest group allows.

A null text counts as the empty text of one byte.  Repeated rows each take a
slot of the same shard.  An empty table gives no rows.  Columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

from .common import ranked, stage, text_of

LARGE, POOLS = 8192, 8192


def differencing(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item; the two partial partitions with largest spread are combined, oppositely ordered."""
    if not sizes:
        return []
    # An entry: (-spread, tie, sums in descending order, the items of each)
    heap = [(-n, i, [n] + [0] * (shards - 1), [[i]] + [[] for _ in range(shards - 1)]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        _, _, sums, lanes = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        both = [a + b for a, b in zip(sums, reversed(more))]
        joined = [_extend(a, b) for a, b in zip(lanes, reversed(others))]
        order = sorted(range(shards), key=lambda k: -both[k])
        sums, lanes = [both[k] for k in order], [joined[k] for k in order]
        heapq.heappush(heap, (sums[-1] - sums[0], tie, sums, lanes))
        tie += 1
    out = [0] * len(sizes)
    for shard, items in enumerate(heap[0][3]):
        for i in items:
            out[i] = shard
    return out


def _extend(a: list[int], b: list[int]) -> list[int]:
    """The longer list takes the shorter one."""
    if len(a) < len(b):
        a, b = b, a
    a.extend(b)
    return a


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, group_bytes, shard and slot of every row."""
    spark = docs.sparkSession
    text = text_of()
    rows = stage(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("group"),
        ),
        "sizes",
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    large = F.col("bytes") * LARGE >= total
    item = F.when(large, F.col("group"))
    pool = F.pmod(F.col("group"), F.lit(POOLS)).cast("int")
    items = (
        groups.select(item.alias("large_group"), F.when(~large, pool).alias("pool"), "bytes")
        .groupBy("large_group", "pool")
        .agg(F.sum("bytes").alias("bytes"))
        .collect()  # LARGE + POOLS rows at most
    )
    items.sort(key=lambda r: (-r["bytes"], r["large_group"] is None, r["large_group"] or 0, r["pool"] or 0))
    placed = differencing([r["bytes"] for r in items], shards)
    whole = spark.createDataFrame(
        [(r["large_group"], k) for r, k in zip(items, placed) if r["pool"] is None], "group long, own_shard int"
    )
    pooled = [0] * POOLS
    for r, k in zip(items, placed):
        if r["pool"] is not None:
            pooled[r["pool"]] = k
    # POOLS entries of one digit each: a literal, not a join
    lanes = F.lit("".join(chr(48 + k) for k in pooled))
    shared = F.ascii(F.substring(lanes, F.pmod(F.col("group"), F.lit(POOLS)).cast("int") + 1, F.lit(1))) - 48
    sharded = rows.join(F.broadcast(whole), "group", "left").select(
        "doc_id", "size", "text_crc32", F.coalesce("own_shard", shared).cast("int").alias("shard")
    )
    return ranked(sharded, ["shard"], ["doc_id", "text_crc32", "size"], "slot", chunks=2048)
