"""Toxicity: a convolutional text classifier in numpy.

A word and its beginnings of four to eight letters are hashed to 32 bits; the sum
of their rows in an embedding table stands for the word, so inflected forms share
a stem.  Filters of widths 1, 2 and 3 run over the words of a whole text; each
keeps its maximum, and a logistic layer turns the maxima into a score.  Only hashes
met in ``MET`` training texts or more may have a row; the others add nothing.

The classifier learns from every labelled row that is not held out, once per distinct
text, whatever its length.  Tasks count in how many texts of each label a hash is met, and the ``ROWS``
hashes that tell the labels best get a row.  The first weights are fitted on a few rows
(``SAMPLE`` of each label, the first by a hash, of up to ``TRAIN_WORDS`` words) on
the driver; then ``PASSES`` times every task goes on from the shared weights over its own rows, and
what the tasks changed is averaged.  Scores are shifted to the share of toxic rows among
all labelled ones.  Texts alone give the score.  Thresholds of the verdict are
calibrated by language on a fifth of all labelled texts, set apart from fitting, by counts of
scores in steps of 1 / ``SCALE``: the least score from ``LEAST`` on with a precision of
``PRECISION`` or more, and 0.5 where too few rows tell.

A null text counts as empty and gets a score; so does any other row, alike for
equal texts.  A null language has the common threshold.  Without labels of both
kinds every score is the share of toxic labels (0.5 if there is none).  An empty table
gives no rows.  Columns other than ``doc_id``, ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import frugal, row_slices, stage, strings

WIDTHS, DIMENSIONS, FILTERS = (1, 2, 3), 8, 8
#: Lengths of the beginnings of a word that have rows of their own.
STEMS = (4, 5, 6, 7, 8)
PIECES = 1 + len(STEMS)
#: Labelled rows of each label, and words of a text, that the first weights are fitted on.
SAMPLE, TRAIN_WORDS = 3000, 4000
STEPS, BATCH, RATE = 1500, 32, 0.03
#: Passes over all labelled rows, their rate, and how often a row of the rarer label is taken at most.
PASSES, PASS_RATE, AGAIN = 2, 0.003, 8
#: Rows of the embedding table, ranges of hashes in which texts are counted, and the bits of the
#: filter by doc_id that goes to all tasks.
ROWS, RANGES, BITS = 1 << 17, 64, 1 << 23
PRECISION, LEAST, TELLING = 0.9, 0.3, 10
#: Distinct training texts that a hash must be met in to have a row.
MET = 3
#: Steps of a score in which thresholds are counted, and parts of a weight in which changes are summed.
SCALE, UNIT = 10_000, 1e9

SCORES = "doc_id long, lang string, score double"
_WORDS = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def pieces_of(words: list[str]) -> np.ndarray:
    """Hashes of each word and its beginnings; 0 where it is no longer than the beginning."""
    flat = [
        zlib.crc32(x.encode("utf-8", "surrogatepass")) if x else 0
        for w in words
        for x in (f"{w}$", *(w[:k] if len(w) > k else "" for k in STEMS))
    ]
    return np.array(flat, np.uint32).reshape(-1, PIECES)


class Rows:
    """Rows of the embedding table for words, remembered; row 0 is zero and stands for unknown hashes."""

    def __init__(self, known: np.ndarray, remembered: int = 400_000):
        self.known, self.remembered, self.seen = known, remembered, {}

    def of_hashes(self, hashes: np.ndarray) -> np.ndarray:
        if not self.known.size:
            return np.zeros(hashes.shape, np.int32)
        at = np.minimum(np.searchsorted(self.known, hashes), self.known.size - 1)
        return np.where((self.known[at] == hashes) & (hashes != 0), at + 1, 0).astype(np.int32)

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        words = [words_of(t) for t in texts]
        needed = set().union(*words)
        fresh = list(needed.difference(self.seen))
        if len(self.seen) + len(fresh) > self.remembered:
            self.seen = {w: self.seen[w] for w in needed.intersection(self.seen)}
        for w, row in zip(fresh, self.of_hashes(pieces_of(fresh))):
            self.seen[w] = row.tobytes()
        return [np.frombuffer(b"".join(map(self.seen.__getitem__, w)), np.int32).reshape(-1, PIECES) for w in words]


class Pieces(Rows):
    """The hashes themselves in place of rows."""

    def __init__(self) -> None:
        super().__init__(np.zeros(0, np.uint32))

    def of_hashes(self, hashes: np.ndarray) -> np.ndarray:
        return hashes.view(np.int32)


@dataclass
class Network:
    known: np.ndarray  # sorted hashes
    table: np.ndarray  # a row of zeros, then one for each hash
    filters: list[np.ndarray]  # width x dimensions x filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    squares: np.ndarray | None = None  # of the fit's steps, by row

    @classmethod
    def fresh(cls, known: np.ndarray, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        table = rng.normal(0, 0.02, (known.size + 1, DIMENSIONS)).astype(np.float32)
        table[0] = 0
        return cls(
            known,
            table,
            [rng.normal(0, 0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
            np.zeros(n, np.float32),
            rng.normal(0, 0.5, n).astype(np.float32),
        )

    @staticmethod
    def laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all texts, each followed by blanks for the widest filter, and where each begins."""
        blank = np.zeros((max(WIDTHS), PIECES), np.int32)
        rows = np.concatenate([x for t in texts for x in (t, blank)])
        return rows, np.concatenate([[0], np.cumsum([len(t) + len(blank) for t in texts])])

    def maps(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings and filter values of every position; windows may reach into the blanks."""
        x = self.table[rows[:, 0]]
        for k in range(1, PIECES):
            x += self.table[rows[:, k]]
        values = []
        for f in self.filters:
            z = x @ f[0]
            for j in range(1, len(f)):
                z[:-j] += (x @ f[j])[j:]
            values.append(z)
        return x, np.concatenate(values, 1) + self.bias

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        rows, starts = self.laid(texts)
        _, z = self.maps(rows)
        top = np.maximum(np.maximum.reduceat(z, starts[:-1], 0), 0)
        return top @ self.out + self.out_bias + self.shift

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30).astype(float)))


class _Adam:
    def __init__(self) -> None:
        self.state: dict[int, list] = {}

    def step(self, key: int, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
        m, v, t = self.state.setdefault(key, [np.zeros_like(value), np.zeros_like(value), 0])
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        t = self.state[key][2] = t + 1
        value -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


class _Steps:
    """Steps of a network: logistic loss, the embeddings by Adagrad on the rows a batch touches, the rest by Adam."""

    def __init__(self, net: Network):
        self.net, self.adam = net, _Adam()
        self.offsets = np.repeat(range(len(WIDTHS)), FILTERS)

    def step(self, own: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float, table_rate: float) -> np.ndarray:
        """One batch; ``weight`` adds up to 1.  Gives the rows of the table that it changed."""
        net, adam = self.net, self.adam
        rows, starts = net.laid(own)
        x, z = net.maps(rows)
        top = np.stack([z[a:b].argmax(0) + a for a, b in zip(starts, starts[1:])])
        peak = np.take_along_axis(z, top, 0)
        active = np.maximum(peak, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ net.out + net.out_bias, -30, 30)))
        error = ((p - y) * weight).astype(np.float32)
        d_peak = error[:, None] * net.out * (peak > 0)
        d_x: list[tuple[np.ndarray, np.ndarray]] = []
        for w, f in enumerate(net.filters):
            mine = self.offsets == w
            d, where = d_peak[:, mine], top[:, mine]
            for j in range(len(f)):
                at = np.minimum(where + j, len(x) - 1)
                grad = np.einsum("bf,bfd->df", d, x[at])
                d_x.append((at.ravel(), (d[:, :, None] * f[j].T[None]).reshape(-1, DIMENSIONS)))
                adam.step(10 * w + j, f[j], grad, rate)
        adam.step(100, net.bias, d_peak.sum(0), rate)
        adam.step(101, net.out, active.T @ error + 1e-4 * net.out, rate)
        net.out_bias -= rate * float(error.sum())
        at, grad = (np.concatenate(c) for c in zip(*d_x))
        touched = rows[at]
        ids, inverse = np.unique(touched, return_inverse=True)
        total = np.zeros((ids.size, DIMENSIONS), np.float32)
        np.add.at(total, inverse.reshape(touched.shape), grad[:, None, :])
        total[ids == 0] = 0
        net.squares[ids] += (total * total).mean(1, keepdims=True)
        net.table[ids] -= table_rate * total / np.sqrt(net.squares[ids])
        return ids


def fit(hashes: list[np.ndarray], labels: np.ndarray, known: np.ndarray, seed: int = 7) -> Network:
    """The first weights: ``STEPS`` batches with as many rows of either label; ``known`` holds the sorted hashes with a row."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(known, seed)
    net.squares = np.full((len(net.table), 1), 1e-4, np.float32)
    lookup, steps = Rows(net.known), _Steps(net)
    texts = [lookup.of_hashes(h) for h in hashes]
    by_label = [np.flatnonzero(labels == k) for k in (0, 1)]
    even = np.full(2 * (BATCH // 2), 1 / (2 * (BATCH // 2)))
    for step in range(STEPS):
        chosen = np.concatenate([rng.choice(k, BATCH // 2) for k in by_label])
        steps.step([texts[i] for i in chosen], labels[chosen], even, RATE * (1 - step / STEPS) + 1e-3, 0.1)
    return net


@frugal
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's hashes with the texts of each label that hold them, as sorted arrays by range of the hash."""
    held, counts, lookup = np.zeros(0, np.uint32), np.zeros((2, 0), np.int64), Pieces()
    for batch in batches:
        for part in row_slices(batch, "text"):
            own = [np.unique(x.view(np.uint32)) for x in lookup.of_texts(strings(part.column("text")))]
            label = np.repeat(part.column("toxic").to_numpy(), [len(x) for x in own])
            both = np.concatenate([held, *own])
            held, at = np.unique(both, return_inverse=True)
            new = [np.append(counts[k], label == k) for k in (0, 1)]
            counts = np.stack([np.bincount(at, n, held.size) for n in new]).astype(np.int64)
    belongs = (held.astype(np.uint64) * np.uint64(RANGES) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(belongs, np.arange(RANGES + 1))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            packed = [zlib.compress(np.diff(held[a:b], prepend=np.uint32(0)).tobytes(), 1), zlib.compress(counts[:, a:b].astype(np.int32).tobytes(), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["range", "hashes", "counts"])


@frugal
def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of whole ranges that ``MET`` texts hold, with their counts."""
    own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for i, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("range", "hashes", "counts"))):
            now = np.cumsum(np.frombuffer(zlib.decompress(hashes), np.uint32), dtype=np.uint32)
            n = np.frombuffer(zlib.decompress(counts), np.int32).reshape(2, -1)
            held, sums = own.get(i, (now[:0], np.zeros((2, 0), np.int64)))
            found, at = np.unique(np.concatenate([held, now]), return_inverse=True)
            own[i] = found, np.stack([np.bincount(at, np.append(a, b), found.size) for a, b in zip(sums, n)]).astype(np.int64)
    for held, sums in own.values():
        enough = (sums.sum(0) >= MET) & (held != 0)
        yield pa.RecordBatch.from_arrays([pa.array(x[enough], pa.int64()) for x in (held.astype(np.int64), *sums)], ["hash", "clean", "toxic"])


def telling_hashes(rows: DataFrame, clean: int, toxic: int) -> np.ndarray:
    """The ``ROWS`` hashes, sorted, whose shares of the texts of either label differ most, by chi-square."""
    packed = rows.select("text", "toxic").mapInArrow(_met, "range int, hashes binary, counts binary")
    met = packed.repartition("range").mapInArrow(_often, "hash long, clean long, toxic long")
    both = F.col("clean") + F.col("toxic")
    apart = F.col("toxic") / max(toxic, 1) - F.col("clean") / max(clean, 1)
    chi = apart * apart / (both * (clean + toxic - both) + 1.0)
    # among hashes that tell nothing, those met often come first
    first = met.orderBy(F.desc(chi), F.desc(both), "hash").limit(ROWS)
    return np.sort(first.select("hash").toPandas()["hash"].to_numpy().astype(np.uint32))


def _dense(net: Network) -> np.ndarray:
    """Filters, biases and the logistic layer in rows as wide as the embeddings, with zeros at the end."""
    flat = np.concatenate([*(f.ravel() for f in net.filters), net.bias, net.out, [net.out_bias]]).astype(np.float64)
    return np.append(flat, np.zeros(-flat.size % DIMENSIONS)).reshape(-1, DIMENSIONS)


def _set_dense(net: Network, rows: np.ndarray) -> None:
    flat, at = rows.ravel(), 0
    for f in [*net.filters, net.bias, net.out]:
        f[:] = flat[at : at + f.size].reshape(f.shape)
        at += f.size
    net.out_bias = float(flat[at])


def pass_over(rows: DataFrame, net: Network, share: float, rate: float) -> None:
    """Every task goes over all its rows from the weights of ``net``, which then change by the tasks' average.

    Rows count by their label, so that both labels weigh alike; the rarer one's come
    up to ``AGAIN`` times, each time with less weight.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(net)  # bounded by ROWS
    shares = np.array([1 - share, share])
    times = np.clip(np.rint(shares.max() / shares), 1, AGAIN).astype(np.int64)
    weights = 1 / (2 * shares * times)

    @frugal
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = copy.deepcopy(shared.value)
        steps, lookup, rng = _Steps(own), Rows(own.known), np.random.default_rng(7)
        changed = np.zeros(len(own.table), bool)
        n = 0
        for batch in batches:
            for part in row_slices(batch, "text"):
                texts, y = lookup.of_texts(strings(part.column("text"))), part.column("toxic").to_numpy()
                order = rng.permutation(np.repeat(np.arange(len(y)), times[y]))
                for chosen in np.array_split(order, max(1, -(-order.size // BATCH))):
                    label = y[chosen]
                    changed[steps.step([texts[i] for i in chosen], label, weights[label] / chosen.size, rate, 10 * rate)] = True
                n += len(y)
        if not n:
            return
        at = np.flatnonzero(changed)
        dense = _dense(own) - _dense(shared.value)
        keys = np.concatenate([at, -1 - np.arange(len(dense))])
        moved = np.concatenate([own.table[at].astype(np.float64) - shared.value.table[at], dense])
        # whole numbers, so that the order of the sum does not matter
        moved = np.rint(moved * UNIT).astype(np.int64) * n
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(np.full(keys.size, n), pa.int64()), *map(pa.array, np.ascontiguousarray(moved.T))],
            ["key", "n", *(f"v{i}" for i in range(DIMENSIONS))],
        )

    values = [f"v{i}" for i in range(DIMENSIONS)]
    told = rows.select("text", "toxic").mapInArrow(go, ", ".join(["key long", "n long", *(f"{v} long" for v in values)]))
    told = told.groupBy("key").agg(*((F.sum(v) / F.sum("n") / UNIT).alias(v) for v in values)).toPandas()
    keys, moved = told["key"].to_numpy(), told[values].to_numpy()
    net.table[keys[keys >= 0]] += moved[keys >= 0].astype(np.float32)
    dense = _dense(net)
    dense[-1 - keys[keys < 0]] += moved[keys < 0]
    _set_dense(net, dense)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fit on labelled rows that are not held out; a fifth of the sample calibrates the thresholds."""
    lab = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lab = lab.where(~held_out())
    share = lab.agg(F.avg("toxic"), F.min("toxic"), F.max("toxic")).first()
    constant = Network(*[np.zeros(0)] * 2, [], *[np.zeros(0)] * 2, constant=0.5 if share[0] is None else float(share[0]))
    if share[0] is None or share[1] == share[2]:
        return constant
    mixed = F.xxhash64(F.lit("toxicity"), "text").alias("mixed")
    texts = docs.where("text is not null")
    # narrow rows tell which texts are learnt from; only those are brought
    size = F.regexp_count("text", F.lit(r"\w+")).alias("words")
    known = texts.select(mixed, "doc_id", size).join(lab, "doc_id")
    # a row for each text, so that copies do not fill the sample
    known = known.groupBy("mixed").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").cast("int").alias("toxic"), F.min("words").alias("words"))
    known = stage(known.withColumn("apart", F.pmod("mixed", F.lit(5)) == 0), "labelled")
    n = {(r["apart"], r["toxic"]): r["count"] for r in known.groupBy("apart", "toxic").count().collect()}
    if {k for _, k in n} != {0, 1}:
        return constant
    if len(n) < 4:
        known = known.withColumn("apart", F.lit(False))
        n = {(False, k): n.get((False, k), 0) + n.get((True, k), 0) for k in (0, 1)}
    rows = stage(labelled_texts(texts.select(mixed, "doc_id", "text", "lang"), known), "learnt")
    learnt = rows.where("not apart")
    hashes = telling_hashes(learnt, n[False, 0], n[False, 1])
    fit_on = known.where(~F.col("apart") & (F.col("words") <= TRAIN_WORDS))
    first = [fit_on.where(F.col("toxic") == k).select("mixed").orderBy("mixed").limit(SAMPLE) for k in (0, 1)]
    drawn = learnt.join(F.broadcast(first[0].unionByName(first[1])), "mixed").select("mixed", "text", "toxic").collect()  # twice SAMPLE rows
    drawn.sort(key=lambda r: r["mixed"])
    pieces, y = [pieces_of(words_of(r["text"])) for r in drawn], np.array([r["toxic"] for r in drawn])
    if len({*y.tolist()}) == 2:
        net = fit(pieces, y, hashes)
    else:  # all texts of a label are longer; the passes start from nothing
        net = Network.fresh(hashes, 7)
        net.squares = np.full((len(net.table), 1), 1e-4, np.float32)
    own_share = n[False, 1] / (n[False, 0] + n[False, 1])
    for i in range(PASSES):
        pass_over(learnt, net, own_share, PASS_RATE / (1 + i))
    net.squares = None
    prior = min(max(float(share[0]), 1e-6), 1 - 1e-6)
    net.shift = float(np.log(prior / (1 - prior)))
    net.thresholds = thresholds(rows.where("apart"), net)
    return net


def labelled_texts(texts: DataFrame, known: DataFrame) -> DataFrame:
    """mixed, text, lang, toxic, apart of the rows of ``known``, each once.

    Rows whose doc_id no label can have stay out of the join by a filter of ``BITS`` bits; what passes it is joined exactly.
    """
    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(BITS)).cast("int")
    marks = np.zeros(BITS, bool)
    marks[known.select(bit.alias("bit")).distinct().toPandas()["bit"].to_numpy()] = True  # BITS rows at most
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(marks))

    @frugal
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(marks[batch.column("bit").to_numpy()]))

    kinds = "mixed long, doc_id long, text string, lang string, bit int"
    own = texts.select("mixed", F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), bit.alias("bit"))
    own = own.where("doc_id is not null").mapInArrow(keep, kinds).drop("bit")
    told = known.select("mixed", F.col("doc_id").cast("long"), "toxic", "apart")
    # a text that stands in several rows of one doc_id comes once
    joined = own.join(told, ["mixed", "doc_id"]).groupBy("mixed", "doc_id", "toxic", "apart")
    return joined.agg(F.first("text").alias("text"), F.min("lang").alias("lang")).drop("doc_id")


def thresholds(rows: DataFrame, net: Network) -> dict[str, float]:
    """The threshold of each language with enough toxic rows, from counts of all ``rows`` by score."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    @frugal
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lookup = Rows(own.known)
        for batch in batches:
            for part in row_slices(batch, "text", 1_000_000):
                score = np.floor(own.scores(lookup.of_texts(strings(part.column("text")))) * SCALE).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("toxic"), pa.array(score)], ["lang", "toxic", "score"])

    told = rows.select("text", "lang", "toxic").mapInArrow(rate, "lang string, toxic int, score int")
    counted = told.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "score").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
    counted = stage(counted, "calibration")
    telling = counted.groupBy("lang").agg(F.sum("toxic").alias("all")).where(F.col("all") >= TELLING).select("lang")
    own = counted.join(telling, "lang").toPandas()  # SCALE rows a language at most
    return {
        lang: _threshold(g["score"].to_numpy() / SCALE, g["toxic"].to_numpy(), g["n"].to_numpy()) for lang, g in own.groupby("lang")
    }


def _threshold(score: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> float:
    """From the numbers of toxic rows and of all rows with each score."""
    order = np.argsort(-score)
    right, all_ = np.cumsum(toxic[order]), np.cumsum(n[order])
    ranked = score[order]
    good = np.flatnonzero((right / all_ >= PRECISION) & (ranked >= LEAST))
    if not good.size:
        return 0.5
    last = good[-1]
    below = ranked[last + 1] if last + 1 < ranked.size else 0.0
    # half way to the next row, and not above 0.5 where all rows from there on are good
    middle = max(LEAST, float(ranked[last] + below) / 2)
    return middle if below >= 0.5 else min(0.5, middle)


def classify(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang, score, predicted (score of 0.5 or more) and toxic (by the language's threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # bounded by the sample

    @frugal
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lookup = Rows(own.known)
        for batch in batches:
            for part in row_slices(batch, "text", 1_000_000):
                score = own.scores(lookup.of_texts(strings(part.column("text"))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), pa.array(score, pa.float64())], ["doc_id", "lang", "score"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").mapInArrow(rate, SCORES)
    threshold = F.lit(0.5)
    for lang, value in net.thresholds.items():
        threshold = F.when(F.coalesce("lang", F.lit("")) == lang, value).otherwise(threshold)
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("toxic", F.col("score") >= threshold)


def without_toxic(docs: DataFrame, net: Network) -> DataFrame:
    """The rows, with all their columns, that the verdict does not reject; scored and dropped in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @frugal
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lookup = Rows(own.known)
        for batch in batches:
            for part in row_slices(batch, "text", 1_000_000):
                score = own.scores(lookup.of_texts(strings(part.column("text"))))
                limit = [own.thresholds.get(x, 0.5) for x in strings(part.column("lang"))]
                yield part.filter(pa.array(score < np.array(limit)))

    return docs.mapInArrow(keep, docs.schema)
