"""Fill-in-middle transformation with cuts on a sparse exception index.

A text is cut at code points, its bytes are what is copied.  Only characters of
several bytes make the two differ, so the index holds those alone: their code-point
positions and the excess bytes up to each.  A cut is converted by one binary search
in it, either way; between the exceptions, and in ASCII texts everywhere, positions
differ by a constant.

The cuts, the form and the share of texts left plain follow from hashes of doc_id, so reruns
agree and repeated rows are transformed alike.  Null and empty texts are plain and give an empty
output.  Rows without an id are all cut by the hash of an empty id.  A text that holds a
marker stays plain, as it could not be restored.  Very long texts are cut like any other.  An empty
table gives no rows.  Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import row_slices, text_of, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts in a hundred that are transformed, and those of them with the suffix first.
RATE, SUFFIX_FIRST = 90, 20

CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string"


@dataclass
class Exceptions:
    """Characters of several bytes of one text: ``chars`` their code-point and ``places`` their byte
    positions, ``excess`` the bytes beyond one of all before each, with the total at the end."""

    chars: np.ndarray
    places: np.ndarray
    excess: np.ndarray

    def to_bytes(self, chars: np.ndarray) -> np.ndarray:
        """Byte positions of code-point positions."""
        return chars + self.excess[np.searchsorted(self.chars, chars)]

    def to_chars(self, places: np.ndarray) -> np.ndarray:
        """Code-point positions of byte positions between characters."""
        return places - self.excess[np.searchsorted(self.places, places)]


def exceptions(data: np.ndarray, starts: np.ndarray) -> Iterator[Exceptions]:
    """The index of each text of a batch."""
    places = np.flatnonzero(data >= 0xC0)  # first bytes of longer characters
    lead = data[places]
    excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))])
    bounds = np.searchsorted(places, starts)
    for k in range(len(starts) - 1):
        a, b = bounds[k], bounds[k + 1]
        own, before = places[a:b] - starts[k], excess[a : b + 1] - excess[a]
        yield Exceptions(own - before[:-1], own, before)


def draws(seed: str = "1") -> list[Column]:
    """Four numbers of 32 bits for each doc_id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digest = F.sha2(key, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame, seed: str = "1", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Each text with its middle moved to the end: ``CUT``; lengths are null where the form is plain."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "text"):
                yield _cut(part, rate, suffix_first)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), *draws(seed)).mapInArrow(cut, CUT)


def _cut(part: pa.RecordBatch, rate: int, suffix_first: int) -> pa.RecordBatch:
    data, starts = utf8(part.column("text"))
    h1, h2, h3, h4 = (part.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    first, middle, last = marks[0], marks[2], marks[1]
    rows = []
    for k, index in enumerate(exceptions(data, starts)):
        text = data[starts[k] : starts[k + 1]].tobytes()
        n = len(text) - int(index.excess[-1])
        if not n or h3[k] % 100 >= rate or any(m in text for m in marks):
            rows.append((n, "plain", None, None, None, None, text))
            continue
        chars = np.sort([h1[k] % (n + 1), h2[k] % (n + 1)])
        a, b = index.to_bytes(chars).tolist()
        head, moved, tail = text[:a], text[a:b], text[b:]
        if h4[k] % 100 < suffix_first:
            form, output = "spm", b"".join((last, tail, first, head, middle, moved))
        else:
            form, output = "psm", b"".join((first, head, last, tail, middle, moved))
        rows.append((n, form, int(chars[0]), int(chars[1] - chars[0]), a, b - a, output))
    kinds = (pa.int64(), pa.string(), *[pa.int64()] * 4, pa.binary())
    n, form, *lengths, output = (pa.array(c, t) for c, t in zip(zip(*rows), kinds))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output"]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), n, form, *lengths, output.cast(pa.string())], names)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text before its transformation, from the output and its form alone."""
    body = F.expr(f"substring({output}, {len(PREFIX) + 1})")

    def parts(between: str) -> tuple[Column, Column, Column]:
        one = F.split(body, between, 2)
        two = F.split(one[1], MIDDLE, 2)
        return one[0], two[0], two[1]

    head, tail, moved = parts(SUFFIX)
    tail_first, head_second, moved_last = parts(PREFIX)
    return (
        F.when(F.col(form) == "psm", F.concat(head, moved, tail))
        .when(F.col(form) == "spm", F.concat(head_second, moved_last, tail_first))
        .otherwise(F.col(output))
    )
