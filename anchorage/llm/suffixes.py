"""Removal of repeated strings, found by interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``least`` bytes over it also starts anywhere else.
Strings of that length are dealt to groups that hold all copies of them: the key of a
string is the smallest hash among its grams, so neighbours mostly share one and stand together as one
context, a stretch of text.  Equal contexts are counted, not compared.  The
different contexts of a key, and any that may repeat itself, meet in a shard with others, of bounded size.  There
a suffix order gives the transform, and intervals of suffixes that share a string are
extended backwards, breadth first: at length l an interval's new right end is a
pair of neighbours with a common prefix of l bytes.  Expansion stops at ``least``; neighbours
without a value by then share at least so much, and their strings are repeated.

A key with more than ``MOST`` different contexts, as a license line in very many
texts has, is not given to one shard: its contexts are searched again by longer grams, in
the end by whole strings, each a context, which need no comparison.

Everything is worked out on different texts, and equal texts share the result; a
text that stands in several rows is repeated as a whole if it is long enough.  Rows may share or lack a
doc_id.  Null, empty and short texts lose nothing.  An empty table gives no
rows.  Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import row_id, row_slices, stage, text_of, utf8
from .periods import text_key
from .superminhash import mix

#: Bytes of a string that is removed where it is repeated.
LEAST = 400
#: Gram lengths by which contexts are grouped, the next one for keys with more than ``MOST`` contexts.
GRAMS, MOST = (64, 320, 400), 1024
#: Strings of a context at most, bytes of a shard on average, bytes of the first sort.
LONGEST, SHARD, FIRST = 512, 1 << 20, 7

CONTEXT = "key binary, row long, start long, strings int, gram long, content long, looped boolean"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


def contexts(data: np.ndarray, starts: np.ndarray, least: int, gram: int, longest: int = LONGEST) -> tuple[np.ndarray, ...]:
    """(text, first, last, key, looped) of the contexts of texts in a row: strings start from first to
    before last.  Only a looped context, which has its key's gram twice, may hold equal strings."""
    ends = starts[1:] - least + 1
    if not (ends > starts[:-1]).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    hashes, size = _BYTES[data], 1
    while 2 * size <= gram:
        hashes, size = mix(hashes[:-size] * _STEP + hashes[size:]), 2 * size
    if size < gram:
        hashes = mix(hashes[: len(hashes) - (gram - size)] * _STEP + hashes[gram - size :])
    grams = hashes
    wide, held = least - gram + 1, 1
    while 2 * held <= wide:
        hashes, held = np.minimum(hashes[:-held], hashes[held:]), 2 * held
    if held < wide:
        hashes = np.minimum(hashes[: len(hashes) - (wide - held)], hashes[wide - held :])
    long = np.flatnonzero(ends > starts[:-1])
    fresh = np.zeros(len(hashes), bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    fresh[starts[long]] = True
    inside = np.zeros(len(hashes) + 1, np.int8)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long], -1)
    first = np.flatnonzero(fresh & (np.cumsum(inside[:-1], dtype=np.int8) > 0))
    text = long[np.searchsorted(starts[long], first, "right") - 1]
    last = np.minimum(np.append(first[1:], len(data)), ends[text])
    parts = -(-(last - first) // longest)
    each = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    text, last, key = (np.repeat(x, parts) for x in (text, last, hashes[first]))
    first = np.repeat(first, parts) + each * longest
    last = np.minimum(last, first + longest)
    # how often the key is among the grams of a context
    size = last - first + wide - 1
    begin = np.cumsum(size) - size
    places = np.arange(size.sum()) + np.repeat(first - begin, size)
    many = np.add.reduceat((grams[places] == np.repeat(key, size)).astype(np.int32), begin)
    return text, first, last, key, many > 1


def found_contexts(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """The contexts of each text (key, row, text as bytes), with hashes of their gram and content."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", 1_000_000):
                data, starts = utf8(part.column("text"))
                text, first, last, key, looped = contexts(data, starts, least, gram, LONGEST if gram < least else 1)
                held = memoryview(np.ascontiguousarray(data))
                ends = (last + least - 1).tolist()
                content = [xxhash.xxh3_64_intdigest(held[a:b]) for a, b in zip(first.tolist(), ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(pa.array(text, pa.int64())),
                        part.column("row").take(pa.array(text, pa.int64())),
                        pa.array(first - starts[text], pa.int64()),
                        pa.array((last - first).astype(np.int32)),
                        pa.array(key.view(np.int64)),
                        pa.array(np.array(content, np.uint64).view(np.int64), pa.int64()),
                        pa.array(looped),
                    ],
                    ["key", "row", "start", "strings", "gram", "content", "looped"],
                )

    return texts.select("key", "row", "text").mapInArrow(find, CONTEXT)


def suffix_order(data: np.ndarray, left: np.ndarray, first: int = FIRST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the suffixes of parts that end in different separators, their ranks, and common prefixes
    of neighbours that are shorter than ``first`` (else -1).  ``left``: bytes before the separator.

    Prefix doubling on the suffixes that are not yet alone.
    """
    n = len(data)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([data, np.zeros(first, np.uint8)])
    for j in range(first):
        key = (key << np.uint64(8)) | np.where(left > j, padded[j : j + n], 0).astype(np.uint64)
    short = np.minimum(left, first)
    order = np.argsort((key << np.uint64(8)) | short.astype(np.uint64), kind="stable")
    sorted_key = key[order]
    differ = sorted_key[1:] ^ sorted_key[:-1]
    common = np.full(n - 1, first)
    for j in range(first):  # the leading bytes that agree
        common[(differ >> np.uint64(8 * j)) != 0] = first - 1 - j
    common = np.minimum(common, np.minimum(short[order[1:]], short[order[:-1]]))
    fresh = np.concatenate([[True], common < first])
    prefixes = np.concatenate([[0], np.where(common < first, common, -1)])
    at = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(at, np.diff(np.append(at, n)))
    depth = first
    while True:
        alone = fresh & np.append(fresh[1:], True)
        rows = np.flatnonzero(~alone)
        if not rows.size:
            return order, rank, prefixes
        own = order[rows]
        head, tail = rank[own], rank[own + depth]
        turn = np.argsort(head * n + tail, kind="stable")
        own, head, tail = own[turn], head[turn], tail[turn]
        order[rows] = own
        fresh[rows] = np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])
        at = np.flatnonzero(fresh[rows])
        rank[own] = np.repeat(rows[at], np.diff(np.append(at, rows.size)))
        depth *= 2


def repeated(parts: Sequence[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, first, last) of all stretches of starts of strings of ``least`` bytes that also start elsewhere in the parts."""
    sizes = np.array([len(p) + 1 for p in parts])
    data = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
    n, begins = len(data), np.cumsum(sizes) - sizes
    part = np.repeat(np.arange(len(parts)), sizes)
    left = np.repeat(begins + sizes - 1, sizes) - np.arange(n)
    order, rank, prefixes = suffix_order(data, left, min(FIRST, least))
    depth = min(FIRST, least)
    # the transform: what stands before each suffix, separators each for itself, and where its suffix is
    back = order - 1
    step = rank[back]
    before = data[back]
    byte = np.flatnonzero(left[back] > 0)
    byte = byte[np.argsort(before[byte], kind="stable")]
    same = before[byte[1:]] == before[byte[:-1]]
    earlier, later = np.full(n, -1), np.full(n, n)
    earlier[byte[1:][same]] = byte[:-1][same]
    later[byte[:-1][same]] = byte[1:][same]
    # intervals of one string of ``depth`` bytes whose right end has just been found
    open_ = np.append(prefixes < 0, False)  # neighbours without a common prefix yet
    bounds = np.append(np.flatnonzero(prefixes >= 0), n)
    low, high = bounds[:-1], bounds[1:]
    last = np.append(prefixes, 0)[high] == depth - 1
    low, high = low[last], high[last]
    while depth < least and low.size:
        one = high - low == 1
        single = step[low[one]]
        low, high = low[~one], high[~one]
        size = high - low
        rows = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
        firsts = rows[earlier[rows] < np.repeat(low, size)]
        lasts = rows[later[rows] >= np.repeat(high, size)]
        # the extensions of all intervals are disjoint, so first and last rows pair up in order
        low = np.concatenate([single, np.sort(step[firsts])])
        high = np.concatenate([single, np.sort(step[lasts])]) + 1
        new = open_[high]
        low, high = low[new], high[new]
        open_[high] = False
        depth += 1
    shared = np.flatnonzero(open_)
    marked = np.zeros(n + 1, bool)
    marked[order[shared]] = marked[order[shared - 1]] = True
    edge = np.flatnonzero(marked[1:] != marked[:-1]) + 1
    if marked[0]:
        edge = np.concatenate([[0], edge])
    first, last = edge[::2], edge[1::2]
    owner = part[first]
    return owner, first - begins[owner], last - begins[owner]


def _solved(rows: DataFrame, shards: int, least: int) -> DataFrame:
    """gram, content, first, last: repeated strings among contexts (gram, content, bytes), shard by shard."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, {}

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                names = list(held)
                owner, first, last = repeated(list(held.values()), least)
                gram, content = np.array(names, np.int64).reshape(-1, 2)[owner].T
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (gram, content, first, last)], ["gram", "content", "first", "last"])

        for batch in batches:
            for number, gram, content, own in zip(*(batch.column(c).to_pylist() for c in ("shard", "gram", "content", "bytes"))):
                if number != shard:
                    yield from told()
                    shard, held = number, {}
                held[gram, content] = own
        yield from told()

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))
    dealt = dealt.select("shard", "gram", "content", "bytes").repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(find, "gram long, content long, first long, last long")


def _bytes_of(texts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """gram, content, hot, bytes of the wanted contexts (key, row, start, strings, ...), from one row of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                out = []
                for text, places in zip(part.column("text"), part.column("places").to_pylist()):
                    held = memoryview(text.as_buffer())
                    out += [(p["gram"], p["content"], p["hot"], bytes(held[p["start"] : p["start"] + p["strings"] + least - 1])) for p in places]
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["gram", "content", "hot", "bytes"])

    by_text = wanted.groupBy("key", "row").agg(F.collect_list(F.struct("gram", "content", "hot", "start", "strings")).alias("places"))
    rows = texts.join(stage(by_text, "wanted"), ["key", "row"]).select("text", "places")
    return rows.mapInArrow(cut, "gram long, content long, hot boolean, bytes binary")


def repeated_strings(texts: DataFrame, least: int = LEAST, grams: Sequence[int] = GRAMS, most: int = MOST) -> DataFrame:
    """key, first, last: stretches of starts of strings that are repeated in other texts or places.

    ``texts``: key, row (any number), text as bytes.  Rows of equal keys are one text, read again from its first row.
    """
    found = found_contexts(texts, least, grams[0]).groupBy("key", "start")
    places = stage(found.agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("strings", "gram", "content", "looped"))), "contexts")
    place = F.struct("key", "start", "row", "strings")
    kinds = stage(
        places.groupBy("gram", "content").agg(
            F.min(place).alias("place"), (F.min(place) != F.max(place)).alias("again"), F.max("looped").alias("looped")
        ),
        "kinds",
    )
    shared = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("many"), F.max("looped").alias("loop")).where("many > 1 or loop")
    met = kinds.join(shared, "gram").select("gram", "content", "place.*", (F.col("many") > most).alias("hot"))
    cut = stage(_bytes_of(texts, met, least), "cut")
    total, hot = cut.agg(F.sum(F.when(~F.col("hot"), F.octet_length("bytes"))), F.max("hot")).first()
    some = [
        kinds.where("again").select("gram", "content", F.lit(0).cast("long").alias("first"), F.col("place.strings").cast("long").alias("last")),
        _solved(cut.where("not hot"), 1 + (total or 0) // SHARD, least),
    ]
    if hot:
        name = F.concat(*(F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("gram", "content")))
        again = repeated_strings(cut.where("hot").select(name.alias("key"), F.lit(0).cast("long").alias("row"), F.col("bytes").alias("text")), least, grams[1:], most)
        number = lambda at: F.conv(F.hex(F.substring("key", at, 8)), 16, -10).cast("long")
        some.append(again.select(number(1).alias("gram"), number(9).alias("content"), "first", "last"))
    told = some[0].unionByName(some[1])
    for more in some[2:]:
        told = told.unionByName(more)
    told = stage(told, "repeated")
    return places.join(told, ["gram", "content"]).select(
        "key", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last")
    )


def without_repeats(docs: DataFrame, least: int = LEAST, grams: Sequence[int] = GRAMS, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, spans removed (first, last) and ``kept``, the bytes that remain, of every row."""
    texts = docs.select(text_key().alias("key"), row_id().alias("row"), text_of().cast("binary").alias("text"))
    long = texts.where(F.octet_length("text") >= least)
    found = repeated_strings(long, least, grams, most)
    copies = long.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.first(F.octet_length("text")).alias("size"))
    whole = copies.where("many > 1").select("key", F.lit(0).cast("long").alias("first"), (F.col("size") - least + 1).cast("long").alias("last"))
    spans = found.unionByName(whole).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("found"))
    spans = stage(spans, "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                cuts, kept = [], []
                for text, own in zip(part.column("text"), part.column("found").to_pylist()):
                    text, merged = text.as_py(), []
                    for stretch in own or []:
                        a, b = stretch["first"], stretch["last"] + least - 1
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    edges = [0, *(x for m in merged for x in m), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if merged else text)
                    cuts.append([{"first": a, "last": b} for a, b in merged])
                span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                sizes = pa.array([len(t.as_buffer()) for t in part.column("text")], pa.int64())
                columns = [part.column("doc_id"), sizes, pa.array(cuts, span), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "spans", "kept"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), text_of().cast("binary").alias("text"))
    joined = rows.join(spans, "key", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<first: bigint, last: bigint>>, kept binary")
