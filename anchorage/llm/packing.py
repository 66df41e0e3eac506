"""Best-fit packing planned on a histogram of lengths.

``pieces`` encodes whole texts and cuts those longer than a sequence.  ``plan``
packs counts, not documents: for each length, longest first, it fills the open
sequences with the least room that still fits, all alike ones at once.  ``place``
ranks the pieces within their length and joins them with the planned slots.

Null and empty texts are one piece with the end id alone.  Repeated rows are
packed each for itself.  An empty table gives no rows.  Columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens
from .common import ranked, row_slices, stage, strings

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, width: int = 2048) -> DataFrame:
    """One row per piece: ids of the text and ``end_id``, cut from the back into full pieces."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(vocabulary), np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            for part in row_slices(batch, "text"):
                out = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(strings(part.column("text")))):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % width or width, n + 1, width)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        own = ids[4 * a : 4 * b]
                        out.append((doc, k, a, b - a, zlib.crc32(own), own))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECES)


@dataclass
class Slot:
    """Ranks first_rank to last_rank of a length go to sequences from first_sequence on, at offset."""

    length: int
    first_rank: int
    last_rank: int
    first_sequence: int
    offset: int


def plan(histogram: dict[int, int], width: int = 2048) -> list[Slot]:
    """Best-fit decreasing over counts; its size follows the number of lengths, not of pieces."""
    slots: list[Slot] = []
    rooms: list[int] = []  # sorted rooms of open sequences
    alike: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
    opened = 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in alike:
                bisect.insort(rooms, room)
                alike[room] = []
            alike[room].append((first, many))

    for length in sorted(histogram, reverse=True):
        rank, last = 0, histogram[length]
        while rank < last:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                # as many new sequences as take all that are left, width // length in each
                first, many = opened, -(-(last - rank) // (width // length))
                opened += many
                room = width
            else:
                room = rooms[at]
                first, many = alike[room].pop()
                if not alike[room]:
                    del alike[room], rooms[at]
            used = min(many, last - rank)
            slots.append(Slot(length, rank, rank + used - 1, first, width - room))
            put(room - length, first, used)
            put(room, first + used, many - used)
            rank += used
    return slots


def place(pieces: DataFrame, width: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces; ``pieces`` should be a stored table, as it is read twice."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # width rows at most
    slots = plan({r["length"]: r["n"] for r in counts}, width)
    planned = spark.createDataFrame(
        [(s.length, s.first_rank, s.last_rank, s.first_sequence, s.offset) for s in slots],
        "length long, first_rank long, last_rank long, first_sequence long, offset long",
    )
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return (
        ranked(pieces.select(kept), ["length"], ["doc_id", "piece", "ids_crc32"], "_rank")
        .join(planned, "length")
        .where(F.col("_rank").between(F.col("first_rank"), F.col("last_rank")))
        .select(*kept, (F.col("first_sequence") + F.col("_rank") - F.col("first_rank")).alias("sequence_id"), "offset")
    )


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, width: int = 2048) -> DataFrame:
    """Pieces with their places, without the ids; ``sequences`` gives the sequences themselves."""
    stored = stage(pieces(docs, vocabulary, end_id, width), "pieces")
    return place(stored.drop("ids"), width)


def sequences(placed: DataFrame) -> DataFrame:
    """Join pieces that still carry ``ids`` into sequences: sequence_id, length, ids."""
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.expr("aggregate(sort_array(collect_list(struct(offset, ids))), cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"),
    )
