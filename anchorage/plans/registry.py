"""All registered queries and SQL counterparts."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import cohort_queries, event_queries, feature_queries, file_queries, text_queries
from .roles import Tables

_MODULES = (cohort_queries, event_queries, feature_queries, file_queries, text_queries)


def _bind(build):
    return lambda spark, folder: build(Tables(spark, folder))


def queries() -> dict:
    return {name: _bind(f) for m in _MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
