"""Composite item keys and document names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def composite_key(*parts: Column | str) -> Column:
    """Comma-joined key of 2-3 columns; a null part prints as empty."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def trim_char(c: Column | str, char: str = '"') -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(char))


def clean_composite_key(key: Column | str, quotes: str = "edges") -> Column:
    """``("a","b",start)`` -> ``a,b,start``.

    Surrounding parentheses go; quotes go from the ends of each part
    (``edges``) or from everywhere (``all``).
    """
    key = F.col(key) if isinstance(key, str) else key
    bare = F.btrim(key, F.lit("()"))
    if quotes == "all":
        return F.translate(bare, '"', "")
    return F.array_join(F.transform(F.split(bare, ","), lambda p: F.btrim(p, F.lit('"'))), ",")


def phase_of(key: Column | str) -> Column:
    """Last part of a composite key (``start`` / ``end`` for drug events)."""
    return F.element_at(F.split(clean_composite_key(key, "all"), ","), -1)


def document_item_id(path: Column | str) -> Column:
    """Base name of an annotated document without its 4-character extension."""
    path = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r".{4}$", "")
