"""Word perplexity: a bigram model of hashed words that grows with the corpus.

Every pair (word before, word) of every text is counted; the model holds the count of
the pair, the tokens and the kinds of pairs after its first word, and the tokens
of its second word.

Texts are read once into batches of about ``HELD`` words, each with a dictionary of its
own, and stored.  From there numbers travel, and texts do not:

* a batch sends the hashes of its distinct pairs, as differences of sorted numbers, to parts of
  about ``PART`` pairs by ranges of the hash.  A part adds up each pair's count and answers with
  one number a pair, in the same order; one batch, the first, is told to count the pair as a kind;
* a batch sends its words with tokens and kinds to parts in the same way, and is answered with
  their totals;
* a batch with its answers scores its texts.

Each is done in turns, and the shuffle files of a turn are removed at its end.
More text makes more batches and parts; none of them grows, and a frequent pair or word is one number a batch.

A text is scored without its own words: its counts are taken off the model's
first, so a row of the corpus has no advantage over a new one.  Discounts are
absolute; pairs back off to words, and words to the character model.

Texts are told apart by a 64-bit hash; equal texts score alike.  Pairs and words are told apart by 56 bits of a
hash.  Words are runs of anything but ASCII white space, without case.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import frugal, row_slices, stage, strings

#: Words of a batch, and bytes of its dictionary; words of a batch that are scored at once; pairs or words of a part of the model.
HELD, HELD_BYTES, SCORED, PART = 1_500_000, 64_000_000, 250_000, 1_000_000
#: Turns of the pairs, which open all batches each, and of the batches and words; discount.
TURNS, BATCH_TURNS, DISCOUNT = 3, 6, 0.75
#: Sums are whole numbers of this part of a nat, so that their order does not matter.
UNIT = 1e6
START = np.uint64(0x5851F42D4C957F2D)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash that are left out.
_CUT = np.uint64(8)

BATCH = "batch long, part int, kind int, payload binary"
_STORED = f"{BATCH}, tokens long, words long"
#: Kinds of rows: a batch of texts, numbers of its pairs, numbers of its words.
TEXTS, PAIRS, WORDS = 0, 1, 2


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def split_words(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words of all, as ``words_of`` finds them."""
    lists = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
    words, starts = lists.values, lists.offsets.to_numpy()
    # blanks at the ends of a text leave empty words
    some = pc.greater(pc.binary_length(words), 0)
    sizes = np.diff(np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))[starts])
    return sizes, words.filter(some)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (before * _MIX) ^ (word + (before >> np.uint64(31)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts_of(high: np.ndarray, parts: int) -> np.ndarray:
    """The range that each hash is in, by its upper 32 bits."""
    return (high * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers, compressed: all lowest bytes, then all second ones, and so on."""
    return pa.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T), "zstd", asbytes=True)


def _numbers(raw: bytes, n: int) -> np.ndarray:
    data = np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data.reshape(8, n).T).view("<u8").reshape(n)


def _joined(n: int, *parts: bytes) -> bytes:
    return b"".join([struct.pack(f"<{len(parts) + 1}q", n, *map(len, parts)), *parts])


def _split(raw: bytes, parts: int) -> tuple[int, list[bytes]]:
    n, *sizes = struct.unpack_from(f"<{parts + 1}q", raw)
    ends = np.cumsum([8 * (parts + 1), *sizes]).tolist()
    return n, [raw[a:b] for a, b in zip(ends, ends[1:])]


def _told(sorted_hashes: np.ndarray, *numbers: np.ndarray) -> bytes:
    """Sorted hashes with numbers of each."""
    return _joined(sorted_hashes.size, _planes(np.diff(sorted_hashes, prepend=np.uint64(0))), *map(_planes, numbers))


def _heard(raw: bytes, numbers: int) -> list[np.ndarray]:
    n, (first, *others) = _split(raw, numbers + 1)
    return [np.cumsum(_numbers(first, n), dtype=np.uint64), *(_numbers(x, n).astype(np.int64) for x in others)]


def _row(batch: int, part: int, kind: int, payload: bytes) -> pa.RecordBatch:
    columns = [pa.array([batch], pa.int64()), pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([payload], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["batch", "part", "kind", "payload"])


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(c) for c in names]
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in columns)


def _grouped(batches: Iterator[pa.RecordBatch], by: str, *names: str) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each value of ``by``; rows must come sorted."""
    now, held = None, []
    for key, *own in _rows(batches, by, *names):
        if now is not None and key != now:
            yield now, held
            held = []
        now = key
        held.append(tuple(own))
    if held:
        yield now, held


def pairs(docs: DataFrame) -> DataFrame:
    """before, word, n: how often each pair of words occurs in all texts; the first word follows a start mark.

    The counts by themselves, a row for each kind of pair; scores take the shorter way of ``answers``.
    """

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                own = [hashes(words_of(t)) for t in strings(part.column("text"))]
                own = [np.column_stack([np.append(START, x[:-1]), x]) for x in own if x.size]
                if own:
                    both, n = np.unique(np.concatenate(own), axis=0, return_counts=True)
                    both = both.view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(n, pa.int64())], ["before", "word", "n"])

    found = docs.select("text").mapInArrow(count, "before long, word long, n long")
    return found.groupBy("before", "word").agg(F.sum("n").alias("n"))


class Batch:
    """Texts as places in a dictionary of their words; the start mark has the place after the last word."""

    def __init__(self, payload: bytes):
        n, (sizes, keys, words, at) = _split(payload, 4)
        n_texts = len(keys) // 8
        self.keys = np.frombuffer(keys, np.int64)
        self.sizes = _numbers(sizes, n_texts).astype(np.int64)
        raw_size = struct.unpack_from("<q", words)[0]
        self.words = pa.decompress(words[8:], raw_size, "zstd", asbytes=True).split(b"\n")
        self.at = _numbers(at, n).astype(np.int32)
        self.hashes = np.append(hashes(self.words), START)
        self.ends = np.cumsum(self.sizes)
        self.before = np.append(np.int32(len(self.words)), self.at[:-1])
        self.before[self.ends - self.sizes] = len(self.words)

    def grams(self) -> np.ndarray:
        return pair_hash(self.hashes[self.before], self.hashes[self.at]) >> _CUT

    def slices(self) -> Iterator[tuple[slice, slice]]:
        """Consecutive texts with about ``SCORED`` words, one text at least, and their words."""
        first = 0
        while first < self.sizes.size:
            start = int(self.ends[first] - self.sizes[first])
            last = max(first + 1, int(np.searchsorted(self.ends, start + SCORED, "right")))
            yield slice(first, last), slice(start, int(self.ends[last - 1]))
            first = last

    @staticmethod
    def packed(keys: list[int], sizes: list[int], words: list[pa.Array]) -> tuple[bytes, int]:
        """The payload, and how many words its dictionary has."""
        coded = pa.chunked_array(words, pa.large_string()).combine_chunks().dictionary_encode()
        at, spelt = coded.indices.to_numpy(), coded.dictionary
        # frequent words get small numbers; words of one count are sorted, which compresses them
        named = pc.sort_indices(spelt).to_numpy()
        order = named[np.argsort(-np.bincount(at, minlength=named.size)[named], kind="stable")]
        place = np.empty(order.size, np.int64)
        place[order] = np.arange(order.size)
        dictionary = b"\n".join(spelt.cast(pa.large_binary()).take(pa.array(order)).to_pylist())
        dictionary = struct.pack("<q", len(dictionary)) + pa.compress(dictionary, "zstd", asbytes=True)
        return _joined(at.size, _planes(np.array(sizes)), np.array(keys, np.int64).tobytes(), dictionary, _planes(place[at])), order.size


def batches_of(docs: DataFrame) -> DataFrame:
    """Stored batches of all texts with words."""

    @frugal
    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        keys, sizes, words, size = [], [], [], 0

        def told() -> pa.RecordBatch:
            payload, n = Batch.packed(keys, sizes, words)
            row = _row(task << 32 | number, 0, TEXTS, payload)
            return row.append_column("tokens", pa.array([sum(sizes)], pa.int64())).append_column("words", pa.array([n], pa.int64()))

        for batch in rows:
            for part in row_slices(batch, "text"):
                n, own = split_words(strings(part.column("text")))
                some = np.flatnonzero(n)
                keys += part.column("key").to_numpy()[some].tolist()
                sizes += n[some].tolist()
                words.append(own)
                size += own.nbytes
                if sum(sizes) >= HELD or size >= HELD_BYTES:
                    yield told()
                    number += 1
                    keys, sizes, words, size = [], [], [], 0
        if keys:
            yield told()

    texts = docs.select(F.xxhash64("text").alias("key"), "text").where("text is not null")
    return stage(texts.mapInArrow(read, _STORED), "batches", freed=True)


def in_turns(make: Callable[[int], DataFrame], turns: int, name: str) -> DataFrame:
    """The rows of all turns, each stored before the next begins."""
    return functools.reduce(DataFrame.unionByName, [stage(make(turn), name, freed=True) for turn in range(turns)])


def _cells(batch: int, kind: int, high: np.ndarray, parts: int, sorted_hashes: np.ndarray, *numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each part with its range of the sorted hashes and their numbers."""
    belongs = parts_of(high, parts)
    for some in np.split(np.arange(belongs.size), np.flatnonzero(np.diff(belongs)) + 1) if belongs.size else []:
        cut = slice(some[0], some[-1] + 1)
        yield _row(batch, int(belongs[some[0]]), kind, _told(sorted_hashes[cut], *(x[cut] for x in numbers)))


def by_part(cells: DataFrame) -> DataFrame:
    return cells.repartition("part").sortWithinPartitions("part", "batch")


def by_batch(turn: int, *rows: DataFrame) -> DataFrame:
    """The rows of this turn's batches: the texts first, then the answers in the order of their parts."""
    own = [r.select("batch", "part", "kind", "payload").where(F.pmod(F.xxhash64("batch"), F.lit(BATCH_TURNS)) == turn) for r in rows]
    return functools.reduce(DataFrame.unionByName, own).repartition("batch").sortWithinPartitions("batch", "kind", "part")


def pair_answers(batches: DataFrame, n_parts: int) -> DataFrame:
    """For each batch and part: twice the total of each of the batch's pairs, and one more if this is the first batch that has it."""

    def make(turn: int) -> DataFrame:
        @frugal
        def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, payload in _rows(rows, "batch", "payload"):
                gram = Batch(payload).grams()
                gram = gram[parts_of(gram >> np.uint64(24), n_parts) % TURNS == turn]
                gram, n = np.unique(gram, return_counts=True)
                yield from _cells(batch, PAIRS, gram >> np.uint64(24), n_parts, gram, n)

        @frugal
        def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, cells in _grouped(rows, "part", "batch", "payload"):
                own = [_heard(raw, 1) for _, raw in cells]
                cuts = np.cumsum([0] + [g.size for g, _ in own])
                _, first, at = np.unique(np.concatenate([g for g, _ in own]), return_index=True, return_inverse=True)
                total = np.bincount(at, np.concatenate([n for _, n in own])).astype(np.int64)
                answer = 2 * total[at]
                answer[first] += 1
                for (batch, _), a, b in zip(cells, cuts, cuts[1:]):
                    yield _row(batch, part, PAIRS, _joined(int(b - a), _planes(answer[a:b])))

        sent = batches.select("batch", "payload").mapInArrow(send, BATCH)
        return by_part(sent).mapInArrow(add, BATCH)

    return in_turns(make, TURNS, "pair_counts")


def _answers(rows: list[tuple], kind: int, numbers: int) -> list[np.ndarray]:
    """The answers to a batch, part by part, so in the order of its sorted hashes."""
    each = []
    for own, raw in rows:
        if own == kind:
            n, fields = _split(raw, numbers)
            each.append([_numbers(x, n).astype(np.int64) for x in fields])
    return [np.concatenate(x) for x in zip(*each)]


def word_answers(batches: DataFrame, counted: DataFrame, n_parts: int) -> DataFrame:
    """For each batch and part, of each of the batch's words: its tokens, those of them with no word after, and those that are no new kind of pair.

    The start mark is a word without tokens, so it has fewer than none with no word after.  Rows of kind ``TEXTS`` say how many words each part has.
    """

    def make(turn: int) -> DataFrame:
        @frugal
        def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, own in _grouped(rows, "batch", "kind", "payload"):
                texts = Batch(own[0][1])
                (answer,) = _answers(own, PAIRS, 1)
                first = _kinds(texts.grams())[0]
                n = texts.hashes.size
                word, before = np.bincount(texts.at, minlength=n), np.bincount(texts.before, minlength=n)
                kinds = np.bincount(texts.before[first[answer & 1 == 1]], minlength=n)
                order = np.argsort(texts.hashes)
                own, high = texts.hashes[order] >> _CUT, texts.hashes[order] >> np.uint64(32)
                # most words are never last and before no word twice, so the differences are mostly 0
                yield from _cells(batch, WORDS, high, n_parts, own, word[order], (word - before)[order], (before - kinds)[order])

        return by_batch(turn, batches, counted).select("batch", "kind", "payload").mapInArrow(send, BATCH)

    @frugal
    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cells in _grouped(rows, "part", "batch", "payload"):
            own = [_heard(raw, 3) for _, raw in cells]
            cuts = np.cumsum([0] + [x[0].size for x in own])
            kinds, at = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True)
            totals = [np.bincount(at, np.concatenate([x[k] for x in own])).astype(np.int64) for k in (1, 2, 3)]
            yield _row(-1, part, TEXTS, struct.pack("<q", np.count_nonzero(totals[0])))
            for (batch, _), a, b in zip(cells, cuts, cuts[1:]):
                yield _row(batch, part, WORDS, _joined(int(b - a), *(_planes(x[at[a:b]]) for x in totals)))

    sent = in_turns(make, BATCH_TURNS, "word_cells").select("batch", "part", "payload")
    return in_turns(lambda turn: by_part(sent.where(F.col("part") % BATCH_TURNS == turn)).mapInArrow(add, BATCH), BATCH_TURNS, "word_counts")


def answers(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """Stored batches, the numbers of their pairs and of their words, and how many tokens and kinds of words there are."""
    batches = batches_of(docs)
    n_tokens, n_local = batches.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "words"))).first()
    counted = pair_answers(batches, 1 + n_tokens // PART)
    said = word_answers(batches, counted, 1 + n_local // PART)

    @frugal
    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (raw,) in _rows(rows, "payload"):
            yield pa.RecordBatch.from_arrays([pa.array(struct.unpack("<q", raw), pa.int64())], ["n"])

    n_words = said.where(F.col("kind") == TEXTS).select("payload").mapInArrow(read, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return batches, counted, said.where(F.col("kind") == WORDS), int(n_tokens), int(n_words)


def log_p(model: np.ndarray, own: np.ndarray, char: np.ndarray, n_tokens: int, n_words: int) -> np.ndarray:
    """Log probability of the word of each pair: ``model`` and ``own`` hold counts with and of the text itself.

    Rows of ``model``: pair, tokens and kinds after its first word, tokens of its
    word.  Rows of ``own``: pair, first word, word.
    """
    pair, before, word = np.maximum(model[[0, 1, 3]] - own, 0)
    base = np.exp(np.clip(char.astype(float), -300, 0))
    p = (np.maximum(word - DISCOUNT, 0) + DISCOUNT * n_words * base) / max(n_tokens, 1)
    kinds = np.minimum(model[2], before)
    with np.errstate(divide="ignore", invalid="ignore"):
        joint = (np.maximum(pair - DISCOUNT, 0) + DISCOUNT * kinds * p) / before
    return np.log(np.maximum(np.where(before > 0, joint, p), 1e-300))


def spelling(words: list[bytes], characters) -> np.ndarray:
    """Log probability of the characters of each word and a blank after it."""
    from .perplexity import ORDER, classes, keys

    out, pad = [], ORDER - 1
    for i in range(0, len(words), 50_000):
        text = (b" ".join(words[i : i + 50_000]) + b" ").decode("utf-8", "surrogatepass")
        ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 32) + 1
        sizes = np.diff(ends, prepend=0)
        # every word has its own start marks
        to = np.arange(len(text)) + pad * np.repeat(np.arange(1, sizes.size + 1), sizes)
        marks = np.zeros(len(text) + pad * sizes.size, np.int32)
        marks[to] = classes(text)[pad:]
        out.append(np.add.reduceat(characters.score(keys(marks)[to - pad]), ends - sizes))
    return np.concatenate(out).astype(np.float32)


def _kinds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the sorted distinct values a place of each and its count, and which of them each place has."""
    order = np.argsort(x)
    own = x[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: own.size])
    n = np.diff(np.append(first, own.size))
    at = np.empty(x.size, np.int32)
    at[order] = np.repeat(np.arange(first.size, dtype=np.int32), n)
    return order[first], n, at


def word_scores(docs: DataFrame, characters) -> DataFrame:
    """key (hash of the text) and word_log_perplexity, nats a word, of every text with words."""
    batches, counted, said, n_tokens, n_words = answers(docs)
    shared = docs.sparkSession.sparkContext.broadcast(characters)  # bounded by its key space

    @frugal
    def rate(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _grouped(rows, "batch", "kind", "payload"):
            texts = Batch(own[0][1])
            (pair,), words = _answers(own, PAIRS, 1), _answers(own, WORDS, 3)
            place = np.argsort(np.argsort(texts.hashes))
            word, last, again = (x[place] for x in words)
            tokens = word - last
            kinds = tokens - again
            grams = _kinds(texts.grams())[2]
            spelt = spelling(texts.words, shared.value)
            for some, inside in texts.slices():
                text = np.repeat(np.arange(some.stop - some.start), texts.sizes[some])
                gram, before, at = grams[inside], texts.before[inside], texts.at[inside]
                # how often the text itself has the pair, the word before (as such) and the word
                (first, n_pair, _), *others = (_kinds(text << 32 | x) for x in (gram, before, at))
                mine = np.stack([n_pair, *(n[where[first]] for _, n, where in others)])
                text, gram, before, at = (x[first] for x in (text, gram, before, at))
                model = np.stack([pair[gram] >> 1, tokens[before], kinds[before], word[at]])
                logs = log_p(model, mine, spelt[at], n_tokens, n_words) * mine[0]
                sums = np.rint(np.bincount(text, -logs, some.stop - some.start) * UNIT).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(texts.keys[some]), pa.array(sums), pa.array(texts.sizes[some])], ["key", "loss", "n"])

    def make(turn: int) -> DataFrame:
        return by_batch(turn, batches, counted, said).select("batch", "kind", "payload").mapInArrow(rate, "key long, loss long, n long")

    sums = in_turns(make, BATCH_TURNS, "losses").groupBy("key").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
    return stage(sums.select("key", (F.col("loss") / F.col("n") / UNIT).alias("word_log_perplexity")), "word_scores", freed=True)
