"""Quality rules: counts of a text, and perplexity bands under a Kneser-Ney model.

The model is over characters in 64 classes, order 4, with modified Kneser-Ney
smoothing.  Tasks count the 4-grams of their whole texts, Spark adds them up and
derives lower orders, discounts and back-off weights with joins and aggregates over
n-gram types.  What is counted grows with the corpus; the model is bounded by the
key space, 64^4 + 64^3 + 64^2 + 64 types (200 MB, some 2 MB on one alphabet), so
it can be broadcast.  It is stored as sorted arrays of n-gram keys and log
probabilities, searched by halving; a task makes a table of the scores after known contexts.

What a text says in words is judged by the model of ``wordmodel``, which grows with
the corpus.

Each language has a band of log perplexity, from its quartiles over the documents
that pass the base rules: ``FENCE`` interquartile ranges beyond them, and
``LEAST`` at least.  Documents outside are rejected.  Word perplexity has an upper
bound by language: ``WORD_FENCE`` times the range from the median to the third
quartile above the latter, and ``WORD_LEAST`` at least.  It has no lower one, as copies would
be below it.

A null text has no words and fails the base rules; its perplexity is null.  A null
language has a band of its own.  Repeated rows are judged alike, and counted each.
An empty table gives no rows.  Only ``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import frugal, row_slices, stage, strings
from .wordmodel import word_scores

ORDER, BITS = 4, 6
CLASSES = 1 << BITS
#: Contexts whose scores a task holds as a table, 512 bytes each; others are searched for.
KNOWN = 1 << 16
#: Width of a band: interquartile ranges beyond the quartiles, and the least range in nats.
FENCE, LEAST = 4.0, 0.03
#: The same above the third quartile of word perplexity, in ranges from the median to it.
WORD_FENCE, WORD_LEAST = 2.0, 0.1
#: Base rules: words a text needs, and per cent of words in repeated windows that it may have.
MIN_WORDS, MAX_REPEATED = 50, 50

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"

SCORED = (
    "key long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, log_perplexity double"
)


def _class_of(char: str) -> int:
    """0 is the start; letters without case, white space, digits and some marks have their own class."""
    c = char.lower()[:1]
    if "a" <= c <= "z":
        return 1 + ord(c) - ord("a")
    if c.isspace():
        return 27
    if c.isdigit():
        return 28
    if c in SYMBOLS:
        return 31
    if c < "\x80":
        return {".": 29, ",": 30}.get(c, 32)
    return 33 + ord(c) % (CLASSES - 33)


_TABLE: np.ndarray | None = None


def classes(text: str) -> np.ndarray:
    """Classes of the code points after ORDER - 1 start marks."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.array([_class_of(chr(c)) for c in range(1 << 16)], np.int32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    own = _TABLE[np.minimum(points, 0xFFFF)]
    far = points > 0xFFFF
    if far.any():
        own[far] = 33 + points[far] % (CLASSES - 33)
    return np.concatenate([np.zeros(ORDER - 1, np.int32), own])


def keys(marks: np.ndarray) -> np.ndarray:
    """The key of the ORDER-gram that ends at each code point."""
    n = marks.size - ORDER + 1
    out = np.zeros(n, np.int32)
    for i in range(ORDER):
        out = out << BITS | marks[i : i + n]
    return out


def grams(docs: DataFrame) -> DataFrame:
    """key, n: how often each ORDER-gram occurs in all texts."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            for part in row_slices(batch, "text"):
                texts = [keys(classes(t)) for t in strings(part.column("text"))]
                own, n = np.unique(np.concatenate(texts), return_counts=True)
                both = np.concatenate([found, own])
                found, at = np.unique(both, return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n]), found.size).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts)], ["key", "n"])

    return docs.select("text").mapInArrow(count, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Per order, from 1: sorted keys with log probabilities, and sorted contexts with log back-off weights."""

    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    #: Scores after the first ``KNOWN`` contexts, made where they are first needed: the row of each context, from 1, and the rows.
    known: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False, compare=False)

    def score(self, key: np.ndarray) -> np.ndarray:
        """Natural log probability of the last symbol of each ORDER-gram; unseen ones back off."""
        if self.known is None:
            contexts = self.contexts[-1][:KNOWN]
            row = np.zeros(CLASSES ** (ORDER - 1), np.int32)
            row[contexts] = np.arange(1, contexts.size + 1)
            every = (np.append(np.zeros(1, np.int32), contexts)[:, None] << BITS | np.arange(CLASSES, dtype=np.int32)).ravel()
            self.known = row, self._searched(every.astype(np.int32))
        row, scores = self.known
        at = row[key >> BITS]
        out = scores[at << BITS | key & (CLASSES - 1)]
        other = np.flatnonzero(at == 0)
        if other.size:
            out[other] = self._searched(key[other])
        return out

    def _searched(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(key.size)
        open_ = np.arange(key.size)
        for order in range(ORDER, 0, -1):
            own = key[open_] & ((1 << BITS * order) - 1)
            at, hit = _find(self.keys[order - 1], own)
            out[open_[hit]] += self.logs[order - 1][at[hit]]
            open_, own = open_[~hit], own[~hit]
            if not open_.size:
                return out
            at, hit = _find(self.contexts[order - 1], own >> BITS)
            out[open_[hit]] += self.weights[order - 1][at[hit]]
        out[open_] -= BITS * np.log(2)
        return out


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not sorted_keys.size:
        return np.zeros(wanted.size, np.int64), np.zeros(wanted.size, bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), sorted_keys.size - 1)
    return at, sorted_keys[at] == wanted


def train(counted: DataFrame) -> Model:
    """The model from the counts of ``grams``, which should be a stored table."""
    # from the highest order down: raw counts, then numbers of distinct symbols on the left
    tables = {ORDER: counted}
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("key").bitwiseAND(F.lit((1 << BITS * order) - 1))
        tables[order] = tables[order + 1].groupBy(suffix.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    model = Model([], [], [], [])
    lower: DataFrame | None = None
    for order in range(1, ORDER + 1):
        table = tables[order].withColumn("context", F.shiftright("key", BITS))
        seen = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]
        n1, n2, n3, n4 = table.agg(*seen).first()
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        # modified Kneser-Ney discounts for counts of one, two, three and more
        d1, d2, d3 = (
            min(max(i - (i + 1) * y * b / a if a else 0.5, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))
        )
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        table = table.withColumn("d", discount)
        held = table.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("weight"))
        joined = table.join(held, "context")
        if lower is None:
            base = F.lit(1.0 / CLASSES)
        else:
            joined = joined.withColumn("_suffix", F.col("key").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)))
            joined = joined.join(lower.select(F.col("key").alias("_suffix"), F.col("p").alias("_p")), "_suffix")
            base = F.col("_p")
        own = joined.select("key", ((F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * base).alias("p"))
        lower = stage(own, f"order{order}")
        a = lower.select("key", F.log("p").cast("float").alias("v")).toPandas()
        b = held.select(F.col("context").alias("key"), F.log("weight").cast("float").alias("v")).toPandas()
        for table_, into, values in ((a, model.keys, model.logs), (b, model.contexts, model.weights)):
            rank = np.argsort(table_["key"].to_numpy())
            into.append(table_["key"].to_numpy(np.int32)[rank])
            values.append(table_["v"].to_numpy(np.float32)[rank])
    return model


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    marked = bytearray(len(words))
    for i, w in enumerate(windows):
        if often[w] > 1:
            marked[i : i + 3] = b"\1\1\1"
    return sum(marked)


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Counts and mean negative log probability of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the key space

    @frugal
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in row_slices(batch, "text"):
                texts = strings(part.column("text"))
                each = [keys(classes(t)) for t in texts]
                sizes = np.array([k.size for k in each])
                logs = np.append(own.score(np.concatenate(each)), 0.0)
                sums = np.add.reduceat(logs, np.minimum(np.cumsum(sizes) - sizes, logs.size - 1))
                told = np.array([counts(t) for t in texts], np.int64).T
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = pa.array(-sums / sizes, mask=sizes == 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("doc_id"), part.column("lang"), *map(pa.array, told), mean],
                    ["key", "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"],
                )

    return docs.select(F.xxhash64("text").alias("key"), F.col("doc_id").cast("long"), "lang", "text").mapInArrow(rate, SCORED)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Counts and both perplexities of every row, by the hash of its text."""
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    rows = score(docs, model).withColumn("base_failed", failed)
    words = word_scores(docs, model)
    return stage(rows.join(words, "key", "left"), "scored")


def bands_of(rows: DataFrame) -> DataFrame:
    """lang, lower, upper and word_upper: the band of log perplexity of each language."""
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.75], 1000)
    by_word = F.percentile_approx("word_log_perplexity", [0.5, 0.75], 1000)
    bands = rows.where("not base_failed").groupBy("lang").agg(quartiles.alias("q"), by_word.alias("w"))
    reach = FENCE * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST))
    above = WORD_FENCE * F.greatest(F.col("w")[1] - F.col("w")[0], F.lit(WORD_LEAST))
    return bands.select(
        "lang", (F.col("q")[0] - reach).alias("lower"), (F.col("q")[1] + reach).alias("upper"), (F.col("w")[1] + above).alias("word_upper")
    )


def judged(rows: DataFrame) -> DataFrame:
    bands = bands_of(rows).withColumnRenamed("lang", "_lang")
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper")) & (F.col("word_log_perplexity") <= F.col("word_upper"))
    return (
        rows.join(bands, F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
        .drop("_lang")
    )


def judge(docs: DataFrame) -> DataFrame:
    """Counts, perplexities, base_failed and kept of every row."""
    return judged(scored(docs, train(stage(grams(docs), "grams")))).drop("key")


def passing(docs: DataFrame) -> DataFrame:
    """The rows, with all their columns, that the rules keep; equal texts of a language are judged alike."""
    rows = judged(scored(docs, train(stage(grams(docs), "grams"))))
    bad = rows.where("not kept").select(F.col("key").alias("bad_key"), F.col("lang").alias("bad_lang")).distinct()
    # the row goes along as one value, so no name of its columns meets one made here
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("key"), F.col("lang").alias("own_lang"))
    alike = (F.col("key") == F.col("bad_key")) & F.col("own_lang").eqNullSafe(F.col("bad_lang"))
    return own.join(bad, alike, "left_anti").select("row.*")
