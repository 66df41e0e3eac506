"""Nearest vocabulary words by edit distance, a block of the vocabulary at a time.

A block of at most ``BLOCK`` words goes to every task, which passes its words by it; each word comes
back with its nearest one of the block, never with pairs.  The block is a tree of beginnings that is
walked once for ``TOGETHER`` words: a step takes a column of the edit matrices of all of them
in a few bit operations (one number of 16, 32 or 64 bits holds a column), and words of the block with a
common beginning share its columns.  Words that are longer, and a few left alone, meet the
words of the block side by side; those whose sets of characters already differ by more than the best
distance found are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words of a block; a block is sent to all tasks.
BLOCK = 50_000
#: Differing characters of the words that are looked at first.
FIRST = 2
#: Words that walk the tree together, and words for which it is not walked.
TOGETHER, ALONE = 1 << 14, 16
#: Numbers that a walk holds.
MASKS = 1 << 23

_ONE = np.uint64(1)


class Vocabulary:
    """A block of words, the longest first, as a matrix of character numbers."""

    def __init__(self, words: Sequence[str]):
        ordered = sorted(set(words), key=lambda w: (-len(w), w))
        self.words = np.array(ordered, dtype=object)
        self.lengths = np.array([len(w) for w in ordered], np.int64)
        self.known: dict[str, int] = {}
        for w in ordered:
            for ch in w:
                self.known.setdefault(ch, len(self.known) + 1)
        width = int(self.lengths.max(initial=0))
        self.codes = np.zeros((width, len(ordered)), np.int32)
        for i, w in enumerate(ordered):
            self.codes[: len(w), i] = [self.known[ch] for ch in w]
        self.sets = np.array([self._set(w) for w in ordered], np.uint64)
        # alphabetical rank settles ties
        self.turn = np.empty(len(ordered), np.int64)
        self.turn[np.argsort(self.words, kind="stable")] = np.arange(len(ordered))

        self.tree = self._tree()

    def _tree(self) -> list[tuple[int, int, int]]:
        """Beginnings of the words, in their order: length, number of the last character, and the word's place or -1."""
        out: list[tuple[int, int, int]] = []
        last = ""
        for place in np.argsort(self.turn).tolist():
            word = self.words[place]
            shared = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            out += [(i + 1, self.known[word[i]], -1) for i in range(shared, len(word))]
            out[-1] = (*out[-1][:2], place)
            last = word
        return out

    @staticmethod
    def _set(word: str) -> int:
        """The characters of a word as bits, several characters to a bit."""
        bits = 0
        for ch in word:
            bits |= 1 << (ord(ch) & 63)
        return bits

    def distances(self, word: str, at: np.ndarray) -> np.ndarray:
        """Edit distances of ``word`` to the words at ascending places ``at``."""
        codes, lengths = self.codes[:, at], self.lengths[at]
        if len(word) > 64:
            return self._plainly(word, codes, lengths)
        masks = np.zeros(len(self.known) + 1, np.uint64)
        for i, ch in enumerate(word):
            if ch in self.known:
                masks[self.known[ch]] |= _ONE << np.uint64(i)
        top = np.uint64(len(word) - 1)
        plus, minus = np.full(at.size, ~np.uint64(0)), np.zeros(at.size, np.uint64)
        score = np.full(at.size, len(word), np.int64)
        for j in range(int(lengths[0])):
            n = int(np.searchsorted(-lengths, -j))  # words longer than j
            p, m, equal = plus[:n], minus[:n], masks[codes[j, :n]]
            x = equal | m
            d = (((x & p) + p) ^ p) | x
            up, down = m | ~(p | d), p & d
            score[:n] += ((up >> top) & _ONE).astype(np.int64) - ((down >> top) & _ONE).astype(np.int64)
            x = (up << _ONE) | _ONE
            plus[:n], minus[:n] = (down << _ONE) | ~(x | d), x & d
        return score

    def _plainly(self, word: str, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        own = [self.known.get(ch, -1) for ch in word]
        row = np.tile(np.arange(len(codes) + 1)[:, None], (1, lengths.size))
        for i, ch in enumerate(own):
            last, row = row, np.empty_like(row)
            row[0] = i + 1
            for j in range(len(codes)):
                row[j + 1] = np.minimum(np.minimum(last[j + 1], row[j]) + 1, last[j] + (codes[j] != ch))
        return row[lengths, np.arange(lengths.size)]

    def nearest(self, word: str, within: int) -> tuple[int, int] | None:
        """Distance and place of the nearest word at most ``within`` away, the first by alphabet of equal ones."""
        if within < 1 or not self.lengths.size:
            return None
        own = np.uint64(self._set(word))
        apart = np.maximum(np.bitwise_count(own & ~self.sets), np.bitwise_count(self.sets & ~own)).astype(np.int64)
        apart = np.maximum(apart, np.abs(self.lengths - len(word)))
        best, low = None, -1
        for high in (FIRST, within):
            limit = within if best is None else best[0]
            at = np.flatnonzero((apart > low) & (apart <= min(high, limit)))
            low = high
            if not at.size:
                continue
            found = self.distances(word, at)
            least = int(found.min())
            if least <= limit:
                tied = at[found == least]
                place = int(tied[np.argmin(self.turn[tied])])
                if best is None or (least, self.turn[place]) < (best[0], self.turn[best[1]]):
                    best = (least, place)
        return best

    def nearest_of_many(self, words: Sequence[str], within: Sequence[int]) -> list[tuple[int, int] | None]:
        """``nearest`` of each word."""
        out: list[tuple[int, int] | None] = [None] * len(words)
        width = np.array([16 if len(w) <= 16 else 32 if len(w) <= 32 else 64 if len(w) <= 64 else 0 for w in words], np.int64)
        for bits, kind in ((16, np.uint16), (32, np.uint32), (64, np.uint64)):
            own = np.flatnonzero(width == bits)
            if own.size <= ALONE or not self.tree:
                width[own] = 0
                continue
            # masks by character and columns by length stay within MASKS numbers
            together = max(1, min(TOGETHER, MASKS // (len(self.known) + 2 * int(self.lengths[0]) + 3)))
            for some in np.array_split(own, -(-own.size // together)):
                best, place = self._walk([words[i] for i in some], kind)
                for i, distance, at in zip(some.tolist(), best.tolist(), place.tolist()):
                    if 1 <= within[i] and distance <= within[i]:
                        out[i] = (distance, at)
        for i in np.flatnonzero(width == 0):
            out[i] = self.nearest(words[i], within[i])
        return out

    def _walk(self, words: Sequence[str], kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Distance and place of the nearest word, the first by alphabet of equal ones."""
        n, one = len(words), kind(1)
        masks, bits = np.zeros((len(self.known) + 1, n), kind), [kind(1 << j) for j in range(max(map(len, words)))]
        for i, word in enumerate(words):
            for bit, ch in zip(bits, word):
                masks[self.known.get(ch, 0), i] |= bit
        masks[0] = 0
        full = np.array([(1 << len(w)) - 1 for w in words], kind)
        deep = max(length for length, _, _ in self.tree)
        plus, minus = np.empty((deep + 1, n), kind), np.empty((deep + 1, n), kind)
        plus[0], minus[0] = ~kind(0), 0
        best, place = np.full(n, 1 << 30, np.int32), np.zeros(n, np.int32)
        x, d, up = (np.empty(n, kind) for _ in range(3))
        ups, downs = np.empty(n, np.uint8), np.empty(n, np.uint8)
        score, nearer = np.empty(n, np.int32), np.empty(n, bool)
        for length, char, word in self.tree:
            p, m, to_p, to_m = plus[length - 1], minus[length - 1], plus[length], minus[length]
            np.bitwise_or(masks[char], m, out=x)
            np.bitwise_and(x, p, out=d)
            np.add(d, p, out=d)
            np.bitwise_xor(d, p, out=d)
            np.bitwise_or(d, x, out=d)
            np.bitwise_or(p, d, out=up)
            np.invert(up, out=up)
            np.bitwise_or(up, m, out=up)
            np.left_shift(up, one, out=up)
            np.bitwise_or(up, one, out=up)
            np.bitwise_and(p, d, out=x)
            np.left_shift(x, one, out=x)
            np.bitwise_or(up, d, out=to_p)
            np.invert(to_p, out=to_p)
            np.bitwise_or(to_p, x, out=to_p)
            np.bitwise_and(up, d, out=to_m)
            if word < 0:
                continue
            # the distance is the sum of the column's steps, from the length of the beginning on
            np.bitwise_count(np.bitwise_and(to_p, full, out=x), out=ups)
            np.bitwise_count(np.bitwise_and(to_m, full, out=x), out=downs)
            np.subtract(ups, downs, out=score, dtype=np.int32)
            np.add(score, np.int32(length), out=score)
            np.less(score, best, out=nearer)
            if nearer.any():
                np.copyto(best, score, where=nearer)
                np.copyto(place, word, where=nearer)
        return best, place


def nearest_in_block(words: DataFrame, block: Sequence[str], k: int | None = None) -> DataFrame:
    """(word, match, distance): the nearest of ``block``, less than the word's length away and at most ``k``."""
    shared = words.sparkSession.sparkContext.broadcast(Vocabulary(block))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        held: list[str] = []

        def told() -> pa.RecordBatch:
            within = [len(w) - 1 if k is None else min(k, len(w) - 1) for w in held]
            rows = [(w, own.words[b[1]], b[0]) for w, b in zip(held, own.nearest_of_many(held, within)) if b]
            columns = zip(*rows) if rows else ((), (), ())
            kinds = (pa.string(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["word", "match", "distance"])

        for batch in batches:
            held += batch.column("word").to_pylist()
            if len(held) >= TOGETHER:
                yield told()
                held = []
        if held:
            yield told()

    return words.select("word").mapInArrow(look, "word string, match string, distance int")


def nearest_by_blocks(words: DataFrame, vocabulary: DataFrame, k: int | None = None, block: int = BLOCK) -> DataFrame:
    """The nearest over all blocks of ``vocabulary`` (word); ``words`` and ``vocabulary`` are stored tables."""
    total = vocabulary.count()
    blocks = max(1, -(-total // block))
    numbered = vocabulary.where(F.length("word") > 0).withColumn("block", F.pmod(F.xxhash64("word"), F.lit(blocks)))
    found = None
    for i in range(blocks):
        own = [r["word"] for r in numbered.where(F.col("block") == i).select("word").collect()]
        told = nearest_in_block(words, own, k)
        found = told if found is None else found.unionByName(told)
    if blocks == 1:
        return found
    best = found.groupBy("word").agg(F.min(F.struct("distance", "match")).alias("b"))
    return best.select("word", "b.match", "b.distance")
