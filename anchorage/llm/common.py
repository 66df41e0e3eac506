"""Helpers shared by the operators: reading, ranking and batches of whole texts."""

from __future__ import annotations

import ctypes
import functools
import shutil
import tempfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from anchorage.session import prepare, stage

__all__ = ["WORD", "frugal", "ranked", "read", "ready", "row_id", "row_slices", "stage", "strings", "text_of", "utf8"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: From here on numbers stand for rows without an id.
NO_ID = 1 << 62

#: Characters of text that a task holds as Python objects at once.
SLICE_CHARS = 2_000_000


_shipped: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Set the session up and hand the package to its Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)  # served by the driver
        _shipped.add(context.applicationId)
    return prepare(spark)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{table}.parquet")


#: Empty what a step keeps in a worker from task to task; workers serve one step after the other.
LEFT: list[Callable[[], None]] = []


def empty_left() -> None:
    for empty in LEFT:
        empty()


def hand_back() -> None:
    """Memory that is free goes back to the machine, as a worker waits for its next task with all it has had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def frugal(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function that first empties what other steps have left in its worker, and last hands memory back."""

    @functools.wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty_left()
        try:
            yield from function(batches)
        finally:
            hand_back()

    return run


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_id() -> Column:
    """doc_id, or for rows without one a number from ``NO_ID`` on by the text; ids are below that."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))


def strings(array: pa.Array) -> list[str]:
    return ["" if x is None else x for x in array.to_pylist()]


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the places where each starts, with the end of the last."""
    own = array.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = own.buffers()
    starts = np.frombuffer(offsets, np.int64)[own.offset : own.offset + len(own) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[starts[0] : starts[-1]], starts - starts[0]


def row_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``limit`` bytes of text each, one row at least."""
    sizes = pc.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield batch.slice(first)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, chunks: int = 256) -> DataFrame:
    """Number the rows of each key from 0, without gaps, in a fixed order.

    Rows are dealt into chunks by a hash of ``order``; a chunk starts where the
    chunks before it end.  No task sorts a whole key, so a key with a third of
    all rows is ranked as fast as any other.
    """
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        dealt.withColumn("_row", F.row_number().over(within) - 1)
        .join(starts, [*keys, "_chunk"])
        .withColumn(name, (F.col("_start") + F.col("_row")).cast("long"))
        .drop("_chunk", "_row", "_start")
    )
