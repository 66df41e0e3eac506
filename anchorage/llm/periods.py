"""Periodic runs of words, found in tiles scaled to the period.

A run is a longest stretch of words with smallest period q that is long enough
(``least`` words and ``times`` periods).  Wherever word i equals word i + q, i
matches; a run is an interval of matches with q words added.  Octave k holds
the periods from 2^k to 2^(k+1) - 1.  Its tiles have a boundary every 2^(k+1)
words, so that each run of the octave has one with 2^k matches after it.
A tile is solved by itself: Z-functions of the words after its boundary and,
backwards, of those before it give the matches around the boundary for every period,
cut at the tile's edges; tiles where no period of the octave has equal blocks of 2^k words (equal
hashes) are passed over.  A period is smallest unless it divides into a shorter
one, which the same Z-function shows.  The interval fragments are
shuffled by text and period and stitched where they touch.

Texts up to ``LONG`` bytes are tiled and solved where they are read.  Longer ones are
exploded into pieces, overlapping by the tiles' width, which are dealt to all
tasks: one text never is the work of one task, except at octaves as wide as the text.

Everything follows from the text alone, so equal texts are solved for one another
and rows may share or lack a doc_id.  Null, empty and blank texts have no words and no
runs.  An empty table gives no rows.  Columns other than ``doc_id`` and ``text`` are not
read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import row_slices, stage, text_of
from .superminhash import mix

#: Words and periods that a run has at least.
LEAST, TIMES = 6, 4
#: Bytes of a text from which on its pieces are dealt out; boundaries of a piece, in words and in tiles.
LONG, PIECE, TILES = 1 << 20, 1 << 16, 8

_FRAGMENT = ("key", "period", "low", "high")
_PIECE = ("first", "last", "shift", "low_octave", "high_octave", "words")
_PIECE_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
#: Rows are fragments or, of long texts, pieces that are still to be solved.
TILED = (
    "key binary, period long, low long, high long, "
    "first long, last long, shift long, low_octave int, high_octave int, words binary"
)

_STEP = np.uint64(0x9E3779B97F4A7C15)


def z_function(s: Sequence[int], upto: int) -> list[int]:
    """For each place below ``upto`` how many items from there on equal those from the start."""
    n = len(s)
    z = [0] * min(upto, n)
    if z:
        z[0] = n
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _primes(q: int) -> list[int]:
    found, d = [], 2
    while d * d <= q:
        if q % d == 0:
            found.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return found + [q] * (q > 1)


def solve_tile(words: np.ndarray, boundary: int, octave: int, periods: Sequence[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """(period, low, high): matches around a boundary for the periods that are smallest ones.

    Intervals that end inside the tile are told if they are long enough,
    those that reach its edge always.
    """
    step = 2 << octave
    reach = step + (1 << octave)  # of matches after the boundary
    start, end = max(0, boundary - step), min(len(words), boundary + step)
    ahead = z_function(words[boundary : boundary + step + reach].tolist(), step)
    before = words[start:boundary][::-1].tolist()
    behind = z_function([*before, None, *words[start:end][::-1].tolist()], len(before) + 1 + end - boundary)
    found = []
    for q in periods:
        after = min(ahead[q], reach)
        back = behind[len(before) + 1 + end - boundary - q]
        whole = after < reach and back < step
        if whole and after + back < max(least, times * q) - q:
            continue
        if after < 1 << octave or any(ahead[q // p] >= q - q // p for p in _primes(q)):
            continue
        found.append((q, boundary - back, boundary + after))
    return found


def solve(words: np.ndarray, octaves: range, first: int, last: int, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Fragments (period, low, high) of all tiles with boundaries from ``first`` to before ``last``."""
    found: list[tuple[int, int, int]] = []
    hashes = mix(words.astype(np.int64).view(np.uint64) + _STEP)
    for k in range(octaves.stop):
        block = 1 << k
        if len(hashes) <= block:
            break
        if k >= octaves.start:
            step = 2 * block
            at = np.arange(-(-first // step) * step, min(last, len(hashes) - block), step)
            padded = np.concatenate([hashes, np.zeros(block, np.uint64)])
            rows = max(1, (1 << 20) // block)
            for i in range(0, at.size, rows):
                own = at[i : i + rows]
                equal = np.lib.stride_tricks.sliding_window_view(padded, block)[own + block] == hashes[own][:, None]
                tile, period = np.nonzero(equal)
                for j in np.unique(tile):
                    periods = (period[tile == j] + block).tolist()
                    found += solve_tile(words, int(own[j]), k, periods, least, times)
        hashes = mix(hashes[:-block] * _STEP + hashes[block:])
    return found


def stitch(owner: np.ndarray, period: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join intervals of the same owner and period that touch."""
    order = np.lexsort((high, low, period, owner))
    owner, period, low, high = (x[order] for x in (owner, period, low, high))
    kept: list[list[int]] = []
    for row in zip(owner.tolist(), period.tolist(), low.tolist(), high.tolist()):
        if kept and kept[-1][:2] == list(row[:2]) and row[2] <= kept[-1][3]:
            kept[-1][3] = max(kept[-1][3], row[3])
        else:
            kept.append(list(row))
    return tuple(np.array(kept, np.int64).reshape(-1, 4).T)


def _numbers(words: list[bytes], known: defaultdict) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def _octaves(n: int, times: int) -> int:
    """Octaves of the periods that fit ``times`` times into n words."""
    return max(0, n // times).bit_length()


def pieces(words: np.ndarray, times: int = TIMES, piece: int = PIECE, tiles: int = TILES) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """(first, last, shift, low octave, high octave, words) of the pieces of one text.

    The low octaves share pieces of ``piece`` boundaries, each octave above has
    its own of ``tiles`` tiles; words reach past both ends by the width of a tile.
    A piece starts at a multiple of its steps, so its boundaries are those of the text.
    """
    n, top = len(words), _octaves(len(words), times)
    low = min(top, max(1, (piece // tiles).bit_length() - 1))
    for a, b in [(0, low)] + [(k, k + 1) for k in range(low, top)]:
        step = 1 << b
        width = step * tiles
        for at in range(0, n, width):
            start, end = max(0, at - step), min(n, at + width + 3 * step)
            yield at - start, min(n, at + width) - start, start, a, b, words[start:end]


def _batch(keys: pa.Array, rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """Fragments (owner, period, low, high) as rows of ``TILED``."""
    owner, *numbers = rows
    n = len(owner)
    columns = [keys.take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in numbers)]
    blank = [pa.nulls(n, t) for t in _PIECE_KINDS]
    return pa.RecordBatch.from_arrays([*columns, *blank], [*_FRAGMENT, *_PIECE])


def tiled(texts: DataFrame, least: int, times: int, long: int) -> DataFrame:
    """Fragments of the texts (key, text) up to ``long`` bytes, pieces of the longer ones."""

    def solved(keys: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        known = defaultdict(count(1).__next__)
        split = [x.split() for x in texts]
        # texts in a row, each after a number that no word has
        rows = [x for k, s in enumerate(split) for x in (np.array([-k - 1], np.int32), _numbers(s, known))]
        words = np.concatenate([*rows, np.array([-len(split) - 1], np.int32)])
        starts = np.cumsum([0] + [len(s) + 1 for s in split])
        octaves = range(_octaves(max(map(len, split)), times))
        found = np.array(solve(words, octaves, 0, len(words), least, times), np.int64).reshape(-1, 3)
        if len(found):
            owner = np.searchsorted(starts, found[:, 1], "right") - 1
            shift = starts[owner] + 1
            yield _batch(keys, stitch(owner, found[:, 0], found[:, 1] - shift, found[:, 2] - shift))

    def exploded(key: bytes, text: bytes) -> Iterator[pa.RecordBatch]:
        edge = np.array([-1], np.int32)
        words = np.concatenate([edge, _numbers(text.split(), defaultdict(count(1).__next__)), edge - 1])
        for row in pieces(words, times):
            values = [key, None, None, None, *row[:5], row[5].tobytes()]
            kinds = (pa.binary(), *[pa.int64()] * 3, *_PIECE_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], [*_FRAGMENT, *_PIECE])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                short = [k for k, x in enumerate(texts) if len(x) <= long]
                if short:
                    yield from solved(part.column("key").take(pa.array(short)), [texts[k] for k in short])
                for k in range(len(texts)):
                    if len(texts[k]) > long:
                        yield from exploded(part.column("key")[k].as_py(), texts[k])

    return texts.mapInArrow(find, TILED)


def _solved_pieces(rows: DataFrame, least: int, times: int) -> DataFrame:
    """Fragments of the pieces, dealt to all tasks."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                first, last, shift, low, high = (batch.column(c)[k].as_py() for c in _PIECE[:-1])
                words = np.frombuffer(batch.column("words")[k].as_buffer(), np.int32)
                rows = np.array(solve(words, range(low, high), first, last, least, times), np.int64).reshape(-1, 3)
                if len(rows):
                    moved = rows[:, 1:] + shift - 1
                    yield _batch(batch.column("key").slice(k, 1), stitch(np.zeros(len(rows), np.int64), rows[:, 0], *moved.T))

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks, "key", "low_octave", "shift").mapInArrow(find, TILED)


def text_key(column: str = "text") -> Column:
    return F.unhex(F.md5(text_of(column)))


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, long: int = LONG) -> DataFrame:
    """key (of the text), start, length, period of every run of every text, each once."""
    texts = docs.select(text_key().alias("key"), text_of().alias("text"))
    rows = stage(tiled(texts, least, times, long), "tiled")
    whole = rows.where("words is null").select(*_FRAGMENT)
    fragments = whole.unionByName(_solved_pieces(rows.where("words is not null"), least, times).select(*_FRAGMENT))
    # copies tell the same fragments; they are made one before the shuffle
    once = fragments.groupBy("key", "period", "low").agg(F.max("high").alias("high"))
    before = Window.partitionBy("key", "period").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("key", "period").orderBy("low").rowsBetween(Window.unboundedPreceding, 0)
    marked = once.withColumn("fresh", F.coalesce(F.col("low") > F.max("high").over(before), F.lit(True)).cast("int"))
    joined = (
        marked.withColumn("island", F.sum("fresh").over(up_to))
        .groupBy("key", "period", "island")
        .agg(F.min("low").alias("start"), (F.max("high") - F.min("low") + F.col("period")).alias("length"))
    )
    return joined.where(F.col("length") >= F.greatest(F.lit(least), times * F.col("period"))).select("key", "start", "length", "period")


def gathered(found: DataFrame) -> DataFrame:
    """key and the runs of a text in one array, by start and period."""
    return found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def described(docs: DataFrame, least: int = LEAST, times: int = TIMES, long: int = LONG) -> DataFrame:
    """doc_id, runs (start, period, length) and ``collapsed``: the text with one period of each run.

    A word goes if a run contains it after the run's first period; words are joined by a blank.
    """
    by_text = stage(gathered(runs(docs, least, times, long)), "runs")

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                out = []
                for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    words = text.encode().split()
                    if spans:
                        cover = np.zeros(len(words) + 1, np.int64)
                        np.add.at(cover, [s["low"] for s in spans], 1)
                        np.add.at(cover, [s["high"] for s in spans], -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                    out.append(b" ".join(words))
                collapsed = pa.array(out, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("runs"), collapsed], ["doc_id", "runs", "collapsed"])

    spans = F.transform("runs", lambda r: F.struct((r.start + r.period).alias("low"), (r.start + r.length).alias("high")))
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), text_key().alias("key")).join(by_text.hint("merge"), "key", "left")
    run = "array<struct<start: bigint, period: bigint, length: bigint>>"
    return rows.select("doc_id", "text", "runs", spans.alias("spans")).mapInArrow(collapse, f"doc_id long, runs {run}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, the first by start and period of equal ones; null without runs."""

    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start: bigint, period: bigint, length: bigint>"), better)
