"""Token-id files compressed by Re-Pair grammars.

``write`` encodes whole texts, sorts them by doc_id and writes blocks of whole
documents.  Each block has a grammar of its own: frequent pairs of neighbouring
symbols are counted and replaced by new symbols again and again, and the rules
are stored with the number of ids that each expands to.  ``read`` decodes every
document, ``decode`` one document or a range of its ids: the lengths lead to
the symbols that cover the range, and only those are expanded.

Null and empty texts hold the end id alone.  Null ids sort first.  Repeated rows
are each stored.  An empty table gives a folder without blocks.  Columns other
than ``doc_id`` and ``text`` are not read.

A block is a row of a Parquet file (shard, block, n_docs, n_tokens, payload).
The payload is little-endian: the magic, then unsigned 32-bit numbers of
documents, rules and symbols, the first rule's symbol, the bytes of a symbol;
then doc ids (int64), null flags (uint8), first id of each document in the block
(uint64), left sides, right sides and symbols (uint16 or uint32), and expansion
lengths of the rules (uint32).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from anchorage.session import stage_dir

from . import tokens
from .common import row_slices, strings

MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIIII")

#: Ids after which a block is closed; a document is never cut.
BLOCK_IDS = 1 << 19
#: Uses a pair needs; a round takes pairs down to this part of the most frequent one's uses.
USES, BAND = 4, 256
#: Hash buckets, as a power of two, in which pairs are counted before they are sorted.
BUCKETS = 18
#: Places from which on pairs are counted by hash first.
FEW = 1 << 14
#: Ids of a rule that are copied at once when it is read.
SHORT = 64

BLOCKS = "shard int, block int, n_docs long, n_tokens long, payload binary"
DOCUMENTS = "shard int, block int, doc_id long, first long, n_tokens long, ids binary"


def _bucket(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left * np.uint32(0x9E3779B1) ^ right * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKETS)


def _narrow_sorted(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    ordered = np.sort(left << np.uint32(16) | right).astype(np.uint64)
    return (ordered >> np.uint64(16)) << np.uint64(32) | ordered & np.uint64(0xFFFF)


def _frequent(symbols: np.ndarray, at: np.ndarray, uses: int) -> tuple[np.ndarray, ...]:
    """Keys of the pairs at the places ``at`` with ``uses`` occurrences or more, their counts, their places, and which pair each is.

    Pairs are first counted by hash: a bucket with fewer occurrences holds no such
    pair, and what is left is sorted.
    """
    left, right = symbols[at], symbols[at + 1]
    if at.size < FEW:
        pairs, rank, counts = np.unique(left.astype(np.uint64) << np.uint64(32) | right, return_inverse=True, return_counts=True)
        enough = counts >= uses
        often = np.flatnonzero(enough[rank])
        return pairs[enough], counts[enough], at[often], (np.cumsum(enough) - 1)[rank[often]]
    bucket = _bucket(left, right)
    often = np.flatnonzero((np.bincount(bucket, minlength=1 << BUCKETS) >= uses)[bucket])
    left, right, bucket = left[often], right[often], bucket[often]
    keys = left.astype(np.uint64) << np.uint64(32) | right
    # symbols of two bytes are sorted as numbers of four, which takes half the time
    ordered = _narrow_sorted(left, right) if left.size and max(left.max(), right.max()) < 1 << 16 else np.sort(keys)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: ordered.size])
    counts = np.diff(np.append(first, ordered.size))
    pairs, counts = ordered[first[counts >= uses]], counts[counts >= uses]
    if not pairs.size:
        return pairs, counts, often[:0], often[:0]
    # a table by bucket finds the pair of a place; a search does where pairs share a bucket
    own = _bucket((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))
    table = np.zeros(1 << BUCKETS, np.int64)
    table[own] = np.arange(pairs.size)
    rank = table[bucket]
    hit = pairs[rank] == keys
    shared = np.bincount(own, minlength=1 << BUCKETS) > 1
    other = np.flatnonzero(~hit & shared[bucket])
    rank[other] = np.minimum(np.searchsorted(pairs, keys[other]), pairs.size - 1)
    hit[other] = pairs[rank[other]] == keys[other]
    return pairs, counts, at[often[hit]], rank[hit]


def _tries(pairs: np.ndarray, counts: np.ndarray, uses: int, band: int) -> Iterator[np.ndarray]:
    """Pairs to replace at once, as a mask: the most frequent; all; where they are in each other's way,
    those whose symbols are dealt a side each, so that none overlap; the pairs one by one."""
    yield counts >= max(uses, counts.max() // band)
    yield np.ones(pairs.size, bool)
    left, right = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    for turn in (1, 2, 3, 4):
        side = [(x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60 - turn)) & np.uint64(1) for x in (left, right)]
        yield (side[0] == 0) & (side[1] == 1)
    for i in np.argsort(-counts, kind="stable"):
        yield np.arange(pairs.size) == i


def _apart(at: np.ndarray, rank: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen pairs and which pair each is; of a run of overlapping ones every second."""
    hit = np.flatnonzero(chosen[rank])
    where, rank = at[hit], rank[hit]
    next_to = np.zeros(where.size, bool)
    np.equal(where[1:] - where[:-1], 1, out=next_to[1:])
    if not next_to.any():
        return where, rank
    i = np.arange(where.size, dtype=np.int32)
    run = np.maximum.accumulate(np.where(next_to, np.int32(0), i))
    take = (i - run) & 1 == 0
    return where[take], rank[take]


def replace_pairs(
    symbols: np.ndarray, first: int, barrier: int, rounds: int | None = None, uses: int = USES, band: int = BAND
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after replacement and the left and right sides of rules first, first + 1, ...

    A round replaces the pairs with at least the most frequent one's uses divided by
    ``band``, and ``uses`` at least; where occurrences overlap, every second of
    the run is taken.  Without a number of ``rounds`` it goes on until no pair has ``uses``
    occurrences apart.  No pair holds ``barrier``, so documents stay apart.
    """
    lefts: list[np.ndarray] = []
    rights: list[np.ndarray] = []
    new, spent = first, 0
    at = np.arange(max(0, symbols.size - 1))
    symbols = symbols.copy()
    while at.size and (rounds is None or spent < rounds):
        inside = symbols != barrier
        inside = inside[:-1] & inside[1:]
        at = np.flatnonzero(inside) if at.size == inside.size else at[inside[at]]
        pairs, counts, at, rank = _frequent(symbols, at, uses)
        if not pairs.size:
            break
        for chosen in _tries(pairs, counts, uses, band):
            where, taken = _apart(at, rank, chosen)
            used = np.bincount(taken, minlength=pairs.size)
            if used.max() >= uses:
                break
        else:
            break
        # pairs that others took their places from wait for a later round
        enough = used >= uses
        number = np.cumsum(enough) - 1
        where, taken = where[enough[taken]], number[taken[enough[taken]]]
        chosen = pairs[enough]
        keep = np.ones(symbols.size, bool)
        keep[where + 1] = False
        symbols[where] = new + taken
        symbols = symbols[keep]
        # only pairs with a new symbol, and those that were frequent before, can be frequent now
        fresh = where - np.arange(where.size)
        others = at[keep[at]]
        if 16 * others.size > keep.size:
            mark = np.zeros(symbols.size + 1, bool)
            for places in ((np.cumsum(keep, dtype=np.int32) - 1)[others], fresh - 1, fresh):
                mark[places] = True
            at = np.flatnonzero(mark[: symbols.size - 1])
        else:
            at = np.sort(np.concatenate([others - np.searchsorted(where + 1, others), fresh - 1, fresh]))
            at = at[(at >= 0) & (at < symbols.size - 1) & (np.diff(at, prepend=-2) > 0)]
        lefts.append((chosen >> np.uint64(32)).astype(np.uint32))
        rights.append((chosen & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        new, spent = new + chosen.size, spent + 1
    none = np.zeros(0, np.uint32)
    return symbols, np.concatenate(lefts or [none]), np.concatenate(rights or [none])


@dataclass
class Block:
    doc_ids: np.ndarray
    nulls: np.ndarray
    starts: np.ndarray
    first: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray


def pack_block(doc_ids: list[int | None], coded: list[bytes], first: int, barrier: int) -> bytes:
    ids = np.frombuffer(b"".join(coded), "<u4")
    starts = np.cumsum([0] + [len(x) // 4 for x in coded[:-1]], dtype="<u8")
    symbols, left, right = replace_pairs(ids, first, barrier)
    sizes = [1] * first
    for a, b in zip(left.tolist(), right.tolist()):
        sizes.append(sizes[a] + sizes[b])
    width = 2 if first + left.size <= 1 << 16 else 4
    numbers = [x.astype(f"<u{width}").tobytes() for x in (left, right, symbols)]
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    own = np.array([x or 0 for x in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, len(doc_ids), left.size, symbols.size, first, width)
    return b"".join([head, own.tobytes(), nulls.tobytes(), starts.tobytes(), *numbers, np.array(sizes[first:], "<u4").tobytes()])


def open_block(payload: bytes) -> Block:
    magic, docs, rules, symbols, first, width = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = _HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, n, at)
        at += out.nbytes
        return out

    kind = f"<u{width}"
    own, nulls, starts = take("<i8", docs), take("u1", docs), take("<u8", docs)
    left, right, seq = take(kind, rules), take(kind, rules), take(kind, symbols)
    return Block(own, nulls, starts, first, left, right, take("<u4", rules), seq)


def _opened(block: Block, symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The symbols with the marked rules opened: every pass opens those of one level."""
    marked = np.append(np.zeros(block.first, bool), rules)
    symbols = symbols.astype(np.uint32)
    while (ruled := marked[symbols]).any():
        at = np.flatnonzero(ruled)
        rule = symbols[at] - block.first
        to = np.arange(symbols.size) + np.cumsum(ruled) - ruled
        out = np.empty(symbols.size + at.size, np.uint32)
        out[to] = symbols
        out[to[at]], out[to[at] + 1] = block.left[rule], block.right[rule]
        symbols = out
    return symbols


def _expand(block: Block, symbols: np.ndarray) -> np.ndarray:
    """Ids of symbols: rules of more than ``SHORT`` ids are opened, all others copied from a table of their ids."""
    short = block.lengths <= SHORT
    symbols = _opened(block, symbols, ~short)
    used = np.zeros(block.first + short.size, bool)
    used[symbols] = True
    rules = np.flatnonzero(used[block.first :])
    table = np.concatenate([np.arange(block.first, dtype=np.uint32), _opened(block, block.first + rules, short)])
    start, size = np.arange(used.size), np.ones(used.size, np.int64)
    size[block.first + rules] = own = block.lengths[rules].astype(np.int64)
    start[block.first + rules] = block.first + np.cumsum(own) - own
    sizes = size[symbols]
    ends = np.cumsum(sizes)
    return table[np.repeat(start[symbols] - ends + sizes, sizes) + np.arange(ends[-1] if ends.size else 0)]


def _symbol_ends(block: Block) -> np.ndarray:
    size = np.concatenate([np.ones(block.first, np.int64), block.lengths])
    return np.cumsum(size[block.symbols])


def decode(payload: bytes, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of a document, by its place in the block; opens only the symbols that cover them."""
    block = open_block(payload)
    ends = _symbol_ends(block)
    bounds = [*block.starts.tolist(), int(ends[-1])]
    first, last = bounds[document], bounds[document + 1]
    a, b = first + start, last if stop is None else min(last, first + stop)
    if a >= b:
        return np.zeros(0, np.uint32)
    i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left"))
    before = int(ends[i - 1]) if i else 0
    return _expand(block, block.symbols[i : j + 1])[a - before : b - before]


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1) -> str:
    """Write the ids of ``docs`` as blocks in ascending doc_id order; a lost task is written again as it was."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = tokens.encoder(vocabulary), TaskContext.get().partitionId()
        first = max(encoder.size, end_id + 1)
        end = np.uint32(end_id).astype("<u4").tobytes()
        ids: list[int | None] = []
        coded: list[bytes] = []
        held = number = 0

        def block() -> pa.RecordBatch:
            row = (shard, number, len(ids), held, pack_block(ids, coded, first, end_id))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip(row, kinds)], ["shard", "block", "n_docs", "n_tokens", "payload"]
            )

        for batch in batches:
            for part in row_slices(batch, "text"):
                for doc, own in zip(part.column("doc_id").to_pylist(), encoder.encode(strings(part.column("text")))):
                    ids.append(doc)
                    coded.append(own + end)
                    held += len(own) // 4 + 1
                    if held >= BLOCK_IDS:
                        yield block()
                        ids, coded, held, number = [], [], 0, number + 1
        if ids:
            yield block()

    (
        docs.select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, BLOCKS)
        .write.parquet(path)
    )
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: its block, place of its first id in the block, and its ids."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, number, payload = (batch.column(k)[row].as_py() for k in ("shard", "block", "payload"))
                block = open_block(payload)
                ids = _expand(block, block.symbols).astype("<u4")
                bounds = np.append(block.starts, ids.size).astype(np.int64)
                raw, n = ids.tobytes(), len(block.doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * n, pa.int32()),
                        pa.array([number] * n, pa.int32()),
                        pa.array(block.doc_ids, pa.int64(), mask=block.nulls.astype(bool)),
                        pa.array(bounds[:-1], pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])], pa.binary()),
                    ],
                    ["shard", "block", "doc_id", "first", "n_tokens", "ids"],
                )

    return spark.read.schema(BLOCKS).parquet(path).select("shard", "block", "payload").mapInArrow(documents, DOCUMENTS)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each block: those of earlier shards, one row each, and of earlier blocks of its shard."""
    blocks = spark.read.schema(BLOCKS).parquet(path).select("shard", "block", "n_tokens")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_shard"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.withColumn("_block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(shards, "shard")
        .select("shard", "block", (F.col("_shard") + F.col("_block")).alias("before"))
    )


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write, read back, and describe: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = write(docs, vocabulary, path or f"{stage_dir(spark)}/token-ids-{uuid.uuid4().hex}", end_id)
    told = read(spark, path).select("shard", "block", "doc_id", "first", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return told.join(block_starts(spark, path), ["shard", "block"]).select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )
