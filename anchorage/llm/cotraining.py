"""Quality classification by co-training a text view and a metadata view.

The text view sees counts of the text alone; the metadata view sees language,
source, length and the page of the same number: its host, address and markup.
Each is a logistic model.  In every round a view labels the unlabelled rows it is
surest of, ``SHARE`` of them of each class and at most ``MOST``, for the other view to
learn from.  Every row is looked at in each round, whose label is not known or held out, and rows of
equal features count once.  Then each view is calibrated on rows set apart, and a logistic model of
both calibrated logits scores every document.

Fits use bounded rows: a sample by a hash of ``SAMPLE`` labelled rows of each label, and
what the rounds pick.  The search, features, join and scores cover every row.  Labels are learnt
only from rows that are not held out.

Null texts are empty, null languages, sources and missing pages are categories
of their own.  Repeated rows score alike.  Several pages of one number count as the
one with the smallest address.  Without labels of both kinds every score is the share
of good labels (0.5 if there is none).  An empty table gives no rows.  Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import row_slices, stage, strings
from .perplexity import counts
from .toxicity import held_out

SAMPLE, MOST = 4000, 200
ROUNDS, SHARE, SURE = 5, 0.02, 0.9
#: Hash buckets for each of language, source and host.
BUCKETS = 64
CATEGORIES = ("lang", "source", "host")


def content_features(text: str) -> list[float]:
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = counts(text)
    words, lines, chars = max(n_words, 1), max(text.count("\n") + 1, 1), max(len(text), 1)
    kinds = len(set(text.lower().split()))
    return [
        float(np.log1p(n_words)), word_chars / words, n_symbols / chars, n_symbols / words, n_dup_lines / lines,
        n_repeat_words / words, kinds / words, np.log1p(kinds) / np.log1p(words + 1), words / lines,
        sum(map(str.isupper, text)) / chars, sum(map(str.isdigit, text)) / chars,
        text.count(".") / words, text.count("|") / words, text.count("!") / words,
    ]


def features(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, content (numbers), numbers and buckets (metadata) of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f for f in docs_columns if f != "text"]
        for batch in batches:
            for part in row_slices(batch, "text"):
                content = [content_features(t) for t in strings(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in names), pa.array(content, pa.list_(pa.float64()))], [*names, "content"]
                )

    docs_columns = ["doc_id", "lang", "source", "n_chars", "text"]
    rows = docs.select(F.col("doc_id").cast("long"), "lang", "source", F.col("n_chars").cast("long"), "text")
    told = rows.mapInArrow(count, "doc_id long, lang string, source string, n_chars long, content array<double>")
    page = pages.groupBy(F.col("page_id").cast("long").alias("_page")).agg(F.min(F.struct("url", "html")).alias("p"))
    url, html = F.col("p.url"), F.coalesce("p.html", F.lit(""))
    page = page.select(
        "_page",
        F.regexp_extract(F.coalesce(url, F.lit("")), r"^\w+://([^/?#]*)", 1).alias("host"),
        F.array(
            F.lit(1.0), F.startswith(url, F.lit("https")).cast("double"), F.contains(url, F.lit("?")).cast("double"),
            F.log1p(F.length(html)), F.regexp_count(html, F.lit("<a ")) / 10.0, F.regexp_count(html, F.lit("<p")) / 10.0,
        ).alias("page_numbers"),
    )
    joined = told.join(page, F.col("doc_id") == F.col("_page"), "left")
    none = F.array(*[F.lit(0.0)] * 6)
    own = F.transform(F.coalesce("page_numbers", none), lambda x: F.coalesce(x, F.lit(0.0)))
    length = F.log1p(F.coalesce("n_chars", F.lit(0)).cast("double"))
    bucket = lambda i, c: F.pmod(F.xxhash64(F.lit(c), F.col(c)), F.lit(BUCKETS)).cast("int") + i * BUCKETS
    return joined.select(
        "doc_id",
        "content",
        F.concat(F.array(length, length * length / 10), own).alias("numbers"),
        F.array(*[bucket(i, c) for i, c in enumerate(CATEGORIES)]).alias("buckets"),
    )


@dataclass
class Logistic:
    """Logistic regression on standardised columns, by Newton steps with a ridge."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        mean, scale = x.mean(0), x.std(0) + 1e-6
        z = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -8, 8)])
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:]

    def p(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def views(rows: list) -> tuple[np.ndarray, np.ndarray]:
    content = np.array([r["content"] for r in rows], float)
    content = np.column_stack([content, content * content])
    one_hot = np.zeros((len(rows), BUCKETS * len(CATEGORIES)))
    for i, r in enumerate(rows):
        one_hot[i, r["buckets"]] = 1
    return content, np.column_stack([np.array([r["numbers"] for r in rows], float), one_hot])


@dataclass
class Pair:
    text: Logistic | None = None
    meta: Logistic | None = None
    text_scale: Logistic | None = None
    meta_scale: Logistic | None = None
    both: Logistic | None = None
    constant: float | None = None

    def calibrated(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.column_stack(
            [self.text_scale.logit(self.text.logit(content)[:, None]), self.meta_scale.logit(self.meta.logit(meta)[:, None])]
        )

    def scores(self, rows: list) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        return self.both.p(self.calibrated(*views(rows)))


class Unlabelled:
    """Distinct feature rows without a label, searched in Spark."""

    def __init__(self, rows: DataFrame):
        columns = ["content", "numbers", "buckets"]
        keyed = rows.select(F.xxhash64(*columns).alias("key"), *columns)
        self.rows = stage(keyed.groupBy("key").agg(*[F.first(c).alias(c) for c in columns]), "unlabelled")
        self.n = self.rows.count()
        self.most = max(1, min(MOST, int(SHARE * self.n)))

    def surest(self, models: list[Logistic], taken: list[set[int]]) -> dict[tuple[int, float], list]:
        """By (pupil, label): the free rows that the other view is surest of."""
        if not self.n:
            return {}
        most = self.most
        shared = self.rows.sparkSession.sparkContext.broadcast((models, [np.array(sorted(t), np.int64) for t in taken]))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # the best so far of each pupil and label: sureness, key and features
            best: dict[tuple[int, float], list] = {}
            own, gone = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    rows = batch.slice(at, 2000).to_pylist()
                    keys = np.array([r["key"] for r in rows], np.int64)
                    seen = views(rows)
                    for pupil in (0, 1):
                        p = own[1 - pupil].p(seen[1 - pupil])
                        free = ~np.isin(keys, gone[pupil])
                        for label, sure in ((1.0, p), (0.0, 1 - p)):
                            good = np.flatnonzero(free & (sure >= SURE))
                            good = good[np.lexsort((keys[good], -sure[good]))[:most]]
                            if good.size:
                                all_ = best.get((pupil, label), []) + [(-float(sure[i]), int(keys[i]), rows[i]) for i in good]
                                best[pupil, label] = sorted(all_, key=lambda x: x[:2])[:most]
            found = [{"pupil": k, "label": y, "sure": -c, **r} for (k, y), some in best.items() for c, _, r in some]
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=told)

        numbers = pa.list_(pa.float64())
        told = pa.schema(
            [("pupil", pa.int32()), ("label", pa.float64()), ("sure", pa.float64()), ("key", pa.int64())]
            + [("content", numbers), ("numbers", numbers), ("buckets", pa.list_(pa.int32()))]
        )
        schema = "pupil int, label double, sure double, key long, content array<double>, numbers array<double>, buckets array<int>"
        found = stage(self.rows.mapInArrow(search, schema), "surest")
        shared.unpersist()
        return {
            (k, y): found.where((F.col("pupil") == k) & (F.col("label") == y)).orderBy(F.col("sure").desc(), "key").limit(most).collect()
            for k in (0, 1)
            for y in (1.0, 0.0)
        }


def co_train(labelled: list, y: np.ndarray, pool: Unlabelled) -> Pair:
    """Rounds of exchange, then calibration on a fifth of the labelled rows."""
    content, meta = views(labelled)
    apart = np.arange(len(y)) % 5 == 0
    if len({*y[~apart]}) < 2 or len({*y[apart]}) < 2:
        apart = np.zeros(len(y), bool)
    calibrate = apart if apart.any() else ~apart
    x = [content[~apart], meta[~apart]]
    own = [y[~apart].astype(float)] * 2
    taken: list[set[int]] = [set(), set()]
    models = [Logistic.fit(*v) for v in zip(x, own)]
    for _ in range(ROUNDS):
        found = pool.surest(models, taken)
        if not any(found.values()):
            break
        for (pupil, label), rows in found.items():
            if rows:
                taken[pupil] |= {r["key"] for r in rows}
                x[pupil] = np.vstack([x[pupil], views(rows)[pupil]])
                own[pupil] = np.append(own[pupil], np.full(len(rows), label))
        models = [Logistic.fit(*v) for v in zip(x, own)]
    out = Pair(*models)
    yc = y[calibrate].astype(float)
    out.text_scale = Logistic.fit(out.text.logit(content[calibrate])[:, None], yc)
    out.meta_scale = Logistic.fit(out.meta.logit(meta[calibrate])[:, None], yc)
    out.both = Logistic.fit(out.calibrated(content[calibrate], meta[calibrate]), yc)
    return out


def classify(docs: DataFrame, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and predicted of every row."""
    rows = stage(features(docs, pages), "features")
    lab = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = rows.join(lab, "doc_id", "left")
    mixed = F.xxhash64(F.lit("quality"), "doc_id")
    sample: list = []
    for label in (0, 1):
        sample += known.where((F.col("quality") == label) & ~held_out()).orderBy(mixed).limit(SAMPLE).collect()
    y = np.array([r["quality"] for r in sample])
    order = np.argsort([hash((r["doc_id"], 17)) for r in sample], kind="stable")
    if len({*y}) < 2:
        pair = Pair(constant=float(y.mean()) if len(y) else 0.5)
    else:
        pool = Unlabelled(known.where(F.col("quality").isNull() | held_out()))
        pair = co_train([sample[i] for i in order], y[order], pool)
    shared = docs.sparkSession.sparkContext.broadcast(pair)  # a few hundred numbers

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(shared.value.scores(part.to_pylist()), pa.float64())], ["doc_id", "score"]
                )

    scored = rows.mapInArrow(rate, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
