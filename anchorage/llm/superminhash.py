"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

Documents with equal shingle sets are a class with one representative, so exact
copies are never compared.  A signature is cut into bands; representatives that
share a band are candidates, and two sets at the threshold share one with a
probability of 1 - 3e-5 (more above it).  Candidates are confirmed on full sets,
in three rounds: the members of each bucket against one of them, in some
bands and then in all; then, wherever a bucket still holds several components, all
pairs across them.  Pairs inside a component need no look, so a large group of
near copies costs about as many comparisons as it has members.  In the last
round a bucket is dealt into blocks, and pairs whose signatures agree in
fewer slots than the threshold less ``DEVIATIONS`` standard deviations are passed over;
members of different sizes by more than the threshold are exactly out.

Components are the smallest labels that spread along links with pointer jumping,
a stored table per step.

Null, empty and blank texts have empty sets and are linked with nothing.  A text
with fewer words than a shingle is one shingle.  Rows that share a doc_id count as
repeated rows; rows without one are told apart by their text, and have a null component_id where no
member of the component has an id.  An empty table gives no rows.  Columns other than ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import NO_ID, frugal, row_id, row_slices, stage, strings

#: Words of a shingle; bands, rows of a band; similarity in per cent.
SHINGLE, BANDS, ROWS, SIMILAR = 4, 44, 7, 80
#: Bands of the first round, rows of a block, and standard deviations in doubt.
FIRST_BANDS, BLOCK, DEVIATIONS = 8, 512, 4.0

SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; the whole of a shorter text is one."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(found))
    out = np.full(len(found) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * _MIX[2] + own[i : len(own) - n + 1 + i])
    return np.unique(out)


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash: a row of ``size`` values for each set, infinite for empty sets.

    In step j every element draws a rank in [j, j + 1) for the j-th slot of its own
    permutation.  A set whose slots all have a value after step j is done: later
    ranks are larger.
    """
    out = np.full((len(sets), size), np.inf)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    hashes = np.concatenate([*sets, np.zeros(0, np.uint64)])
    places: np.ndarray | None = None
    for j in range(size):
        if not hashes.size:
            break
        drawn = mix(hashes + np.uint64((j + 1) * int(_MIX[2]) & 0xFFFFFFFFFFFFFFFF))
        rank = (drawn >> np.uint64(32)).astype(np.float64) / 2.0**32 + j
        swap = ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64) + j
        if places is None:
            slot = swap
        else:
            each = np.arange(hashes.size)
            slot = places[each, swap].astype(np.int64)
            places[each, swap] = places[:, j]
        np.minimum.at(flat, owner * size + slot, rank)
        done = np.isfinite(out).all(1)
        stay = ~done[owner]
        if not stay.all():
            hashes, owner, swap = hashes[stay], owner[stay], swap[stay]
            places = places[stay] if places is not None else None
        if places is None and hashes.size:
            places = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (hashes.size, 1))
            places[np.arange(hashes.size), swap] = 0
    return out


def bands(signature: np.ndarray, count: int = BANDS) -> np.ndarray:
    """A key for each band of each row."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), count, signature.shape[1] // count)
    out = np.tile(np.arange(count, dtype=np.uint64), (len(signature), 1))
    for i in range(bits.shape[2]):
        out = mix(out * _MIX[2] + bits[:, :, i])
    return out.view(np.int64)


def digest(hashes: np.ndarray) -> bytes:
    """Equal sets have equal digests."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


@functools.lru_cache(maxsize=100_000)
def _alpha(size: int, union: int) -> float:
    """Variance of a SuperMinHash estimate over that of independent ranks, by the published formula."""
    if union < 2 or size < 2:
        return 1.0
    k = np.arange(1, size, dtype=float)
    # powers over (size - 1)^(union - 1) size^union, in logarithms
    scale = (union - 1) * math.log(size - 1) + union * math.log(size) + math.log(union - 1)
    with np.errstate(divide="ignore"):
        low, mid, high = (union * np.log(x) for x in (k - 1, k, k + 1))
    terms = np.exp(mid + high - scale) + np.exp(mid + low - scale) - 2 * np.exp(2 * mid - scale)
    return float(np.clip(1 - terms.sum(), 0.0, 1.0))


def doubtful(first: int, others: np.ndarray, size: int = BANDS * ROWS, similar: int = SIMILAR) -> np.ndarray:
    """Slots that must agree at least for a pair of set sizes to be looked at."""
    j = similar / 100
    unions = ((first + others) / (1 + j)).astype(int)
    steps = np.unique(unions)
    alpha = np.array([_alpha(size, max(2, int(u))) if u < 20 * size else 1.0 for u in steps])
    deviation = np.sqrt(j * (1 - j) / size * alpha)[np.searchsorted(steps, unions)]
    return (j - DEVIATIONS * deviation) * size


def signed(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """Set size, digest and band keys of every document, and a sketch: a byte for each slot, four for each band key."""

    @frugal
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text", 1_000_000):
                sets = [shingles(t, words) for t in strings(part.column("text"))]
                full = [k for k, s in enumerate(sets) if s.size]
                sign_of = signatures([sets[k] for k in full])
                keys, marks = bands(sign_of), mix(sign_of.view(np.uint64)).astype(np.uint8)
                low = keys.astype("<u4", casting="unsafe")
                by = dict(zip(full, range(len(full))))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([s.size for s in sets], pa.int64()),
                        pa.array([digest(s) if s.size else None for s in sets], pa.binary()),
                        pa.array([keys[by[k]] if k in by else None for k in range(len(sets))], pa.list_(pa.int64())),
                        pa.array([marks[by[k]].tobytes() + low[by[k]].tobytes() if k in by else None for k in range(len(sets))], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "bands", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, SIGNED)


def sets_of(docs: DataFrame, ids: DataFrame, words: int = SHINGLE) -> DataFrame:
    """id and the full set, as sorted 64-bit numbers, of the documents in ``ids``."""

    @frugal
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                sets = [shingles(t, words).tobytes() for t in strings(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "members"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    return wanted.mapInArrow(gather, "id long, members binary").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    @frugal
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in ("set_a", "set_b"))
                common = np.intersect1d(x, y, assume_unique=True).size
                found.append(100 * common >= similar * (x.size + y.size - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(found))

    a, b = (sets.select(F.col("id").alias(k), F.col("members").alias(f"set_{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Spread the smallest label along links (a, b) until nothing changes.

    ``labels``: id, label, where label is the id of a member of the component.
    """
    both = links.select("a", "b").union(links.select("b", "a")).join(labels.select(F.col("id").alias("a"), F.col("label").alias("from")), "a")
    edges = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("to")), "b").select("from", "to").where("from != to").distinct()
    edges = stage(edges, "edges")
    roots = stage(edges.select(F.col("from").alias("id")).distinct().withColumn("root", F.col("id")), "roots")
    while True:
        near = edges.join(roots.select(F.col("id").alias("to"), "root"), "to").groupBy(F.col("from").alias("id")).agg(F.min("root").alias("near"))
        lower = roots.join(near, "id", "left").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jumps = lower.select(F.col("id").alias("root"), F.col("root").alias("jump"))
        moved = lower.join(jumps, "root", "left").select("id", "old", F.least("root", "jump").alias("root"))
        moved = stage(moved, "roots")
        changed = moved.where("root != old").limit(1).count()
        roots = moved.select("id", "root")
        if not changed:
            break
    named = roots.select(F.col("id").alias("label"), "root")
    return stage(labels.join(named, "label", "left").select("id", F.coalesce("root", "label").alias("label")), "labels")


def _stars(members: DataFrame, labels: DataFrame, number: int) -> DataFrame:
    """Pairs of each bucket's hub with the members of other components."""
    own = members.join(labels, "id")
    turn = F.xxhash64("id", "key", F.lit(number))
    hub = own.groupBy("key").agg(
        F.min_by(F.struct("id", "n", "label"), turn).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    hub = hub.where("low != high").select("key", "hub")
    pairs = own.join(hub, "key").where(
        (F.col("label") != F.col("hub.label"))
        & (100 * F.least("n", "hub.n") >= SIMILAR * F.greatest("n", "hub.n"))
    )
    return pairs.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def _across(members: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """All pairs of a bucket's members across components, but for those whose sketches differ too much.

    Pairs have one side outside the bucket's largest component.  Both sides are
    dealt into blocks, so a task holds two blocks of a bucket at a time.  A pair is
    told by the first band that it shares, and there once.
    """
    own = members.join(labels, "id")
    each = own.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n_label"))
    total = each.groupBy("key").agg(
        F.sum("n_label").alias("n_all"), F.max_by("label", F.struct("n_label", "label")).alias("main"), F.max("n_label").alias("n_main")
    )
    total = total.where("n_all > n_main")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    placed = own.join(total, "key").select(
        "key", "band", "id", "n", "label", (F.col("label") != F.col("main")).alias("minor"),
        blocks(F.col("n_all")).alias("right_blocks"), blocks(F.col("n_all") - F.col("n_main")).alias("left_blocks"),
    )
    dealt = F.xxhash64("id")
    right = placed.select("*", F.lit(False).alias("is_left"), F.pmod(dealt, "right_blocks").cast("int").alias("r")).withColumn(
        "l", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1))
    )
    left = (
        placed.where("minor")
        .select("*", F.lit(True).alias("is_left"), F.pmod(dealt, "left_blocks").cast("int").alias("l"))
        .withColumn("r", F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1)))
    )
    cells = left.unionByName(right).join(sketches, "id")
    columns = ["key", "l", "r", "is_left", "id", "n", "label", "sketch", "band", "minor"]

    def pairs_of(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left_rows = [x for x in rows if x[3]]
        others = [x for x in rows if not x[3]]
        if not others:
            return
        ids, sizes, label, minor = (np.array([x[k] for x in others]) for k in (4, 5, 6, 9))
        sketch = np.frombuffer(b"".join(x[7] for x in others), np.uint8).reshape(len(others), -1)
        slots, band = BANDS * ROWS, others[0][8]
        marks, earlier = sketch[:, :slots], np.ascontiguousarray(sketch[:, slots:]).view("<u4")[:, :band]
        for x in left_rows:
            one, n, own = x[4], x[5], np.frombuffer(x[7], np.uint8)
            ok = (label != x[6]) & (~minor | (ids > one)) & (100 * np.minimum(sizes, n) >= SIMILAR * np.maximum(sizes, n))
            ok = np.flatnonzero(ok)
            ok = ok[~(earlier[ok] == own[slots:].view("<u4")[:band]).any(1)]
            if ok.size:
                agree = (marks[ok] == own[:slots]).sum(1)
                ok = ok[agree >= doubtful(n, sizes[ok])]
                yield np.minimum(ids[ok], one), np.maximum(ids[ok], one)

    @frugal
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def told() -> Iterator[pa.RecordBatch]:
            for a, b in pairs_of(rows):
                if a.size:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if row[:3] != cell:
                    yield from told()
                    cell, rows = row[:3], []
                rows.append(row)
        yield from told()

    sorted_cells = cells.select(columns).repartition("key", "l", "r").sortWithinPartitions("key", "l", "r")
    return sorted_cells.mapInArrow(match, "a long, b long")


def groups(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the component) and kept of every row."""
    has_id = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    return _groups(docs, words).select(has_id("doc_id"), "n_shingles", has_id("component_id"), "kept")


def _groups(docs: DataFrame, words: int) -> DataFrame:
    """The same with numbers in place of missing ids."""
    docs = docs.select(row_id().alias("doc_id"), "text")
    signed_docs = stage(signed(docs, words), "signed")
    full = signed_docs.where("n_shingles > 0")
    classes = stage(full.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    # one row for each class; equal sets have equal bands and sketches
    one = full.join(classes, "digest").where(F.col("doc_id") == F.col("id")).dropDuplicates(["id"])
    one = one.select("id", F.col("n_shingles").alias("n"), "bands", "sketch")
    spread = one.select("id", "n", F.posexplode("bands").alias("band", "key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("key")
    members = stage(spread.join(shared, "key"), "members")
    ids = stage(members.select("id").distinct(), "candidates")
    sets = stage(sets_of(docs, ids, words), "sets")
    sketches = stage(one.select("id", "sketch").join(ids, "id", "left_semi"), "sketches")
    labels = ids.select("id", F.col("id").alias("label"))
    for number, some in enumerate((members.where(F.col("band") < FIRST_BANDS), members)):
        links = confirmed(_stars(some.select("key", "id", "n"), labels, number), sets)
        labels = components(labels, stage(links, "links"))
    links = confirmed(stage(_across(members, labels, sketches), "pairs"), sets)
    labels = components(labels, stage(links, "links"))
    named = classes.join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("_component"))
    component = F.coalesce("_component", "doc_id")
    return (
        signed_docs.select("doc_id", "n_shingles", "digest")
        .join(named, "digest", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
    )


def deduplicated(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """One row of each group, with all its columns: that of the smallest doc_id, the first by text of repeated rows."""
    kept = _groups(docs, words).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    # the row goes along as one value, so no name of its columns meets one made here
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_id().alias("id"))
    rows = own.join(kept, F.col("id") == F.col("kept_id"), "left_semi")
    # an aggregate combines before the shuffle, so that many repeated rows do not meet in one task
    first = F.min_by("row", F.struct("row.text")).alias("first")
    return rows.groupBy("id").agg(first).select("first.*")
