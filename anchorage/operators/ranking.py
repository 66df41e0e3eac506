"""Ordered computations that never need one whole group in one task.

Each operator splits a group into chunks that follow the sort order, works
inside (group, chunk), and carries one summary row per chunk across the
chunks.  A group that holds a third of the table is then as parallel as any.
Key columns are not null; unknown order values form a last chunk of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stage

#: Chunks at least; a cluster with more cores gets two for each, up to the most that limits are searched for.
CHUNKS, MOST_CHUNKS = 64, 2048
_CHUNK = "_chunk"


def quantile_chunk(df: DataFrame, column: str, chunks: int | None = None) -> DataFrame:
    """Add a chunk number that follows ``column`` and holds even row counts.

    The limits are ``chunks - 1`` approximate quantiles (a fixed-size scalar
    subquery, no join).  Only balance depends on them being approximate.
    """
    if chunks is None:
        chunks = min(MOST_CHUNKS, max(CHUNKS, 2 * df.sparkSession.sparkContext.defaultParallelism))
    levels = [i / chunks for i in range(1, chunks)]
    limits = df.select(F.percentile_approx(column, levels, max(1000, 4 * chunks))).scalar()
    # the place of the value among the limits; written without a lambda, whose columns the planner's
    # inference over joins on the chunk does not see
    x = F.col(column)
    among = F.array_position(F.sort_array(F.array_append(F.coalesce("_limits", F.array()), x)), x)
    return (
        df.withColumn("_limits", limits)
        .withColumn(_CHUNK, F.when(x.isNull(), 0).otherwise(among.cast("int") - 1))
        .drop("_limits")
    )


def class_sizes(df: DataFrame, column: str) -> Column:
    """Rows of each value of a column with few values, as a map.

    A scalar subquery of one row per value, so no row meets another by the
    value: a join on a key of two values would send each half to one task.
    """
    sizes = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.map_from_entries(F.collect_list(F.struct(column, "_n")))).scalar()


def time_chunk(df: DataFrame, column: str, unit: str = "month") -> DataFrame:
    """Add a calendar chunk of a timestamp; needs no pass over the data."""
    last = F.lit("9999-12-31").cast("timestamp")
    return df.withColumn(_CHUNK, F.coalesce(F.date_trunc(unit, F.col(column)), last))


def hash_chunk(df: DataFrame, digest: str, digits: int = 2) -> DataFrame:
    """Add the leading hex digits of a digest column as an even chunk."""
    return df.withColumn(_CHUNK, F.substring(digest, 1, digits))


def _join_chunks(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Bring chunk summaries back to the rows of their chunk.

    Plain equality, so the rows keep the partitioning of the chunk window.
    """
    return df.join(summary, [*keys, _CHUNK], "left")


def number_rows(
    df: DataFrame, keys: list[str], order: list[Column], out: str = "row_num"
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` by chunk.

    ``df`` carries a chunk column whose order agrees with ``order``.
    """
    before = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, _CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, _CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = W.partitionBy(*keys, _CHUNK).orderBy(*order)
    numbered = df.withColumn("_in_chunk", F.row_number().over(inside))
    return (
        _join_chunks(numbered, offsets, keys)
        .withColumn(out, F.coalesce("_before", F.lit(0)) + F.col("_in_chunk"))
        .drop("_before", "_in_chunk", _CHUNK)
    )


def running_sum(
    df: DataFrame, keys: list[str], order: str, values: dict[str, str]
) -> DataFrame:
    """Sum of ``values`` over the rows strictly before, per key, by chunk.

    ``values`` maps input column to output column; (keys, order) is unique.
    """
    before = W.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, _CHUNK).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    offsets = totals.select(
        *keys,
        _CHUNK,
        *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
    )
    inside = (
        W.partitionBy(*keys, _CHUNK).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    )
    summed = df.select(
        "*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_i_{v}") for v in values]
    )
    out = _join_chunks(summed, offsets, keys)
    for v, name in values.items():
        out = out.withColumn(name, F.col(f"_i_{v}") + F.col(f"_o_{v}"))
    return out.drop(_CHUNK, *[f"_i_{v}" for v in values], *[f"_o_{v}" for v in values])


def neighbour_values(
    df: DataFrame, keys: list[str], order: str, ahead: dict[str, str], behind: dict[str, str]
) -> DataFrame:
    """``lead(c, 1)`` for ``ahead`` and ``lag(c, 1)`` for ``behind``, by chunk.

    Both map input column to output column.  A chunk's first row is carried to
    the chunk before it and its last row to the chunk after it.
    """
    inside = W.partitionBy(*keys, _CHUNK).orderBy(order)
    across = W.partitionBy(*keys).orderBy(_CHUNK)
    sides = [("_next", F.lead, F.min, ahead), ("_last", F.lag, F.max, behind)]
    sides = [side for side in sides if side[3]]

    def row(columns: dict[str, str]) -> Column:
        return F.struct(F.col(order).alias("_at"), *[F.col(c) for c in columns if c != order])

    edges = (
        df.groupBy(*keys, _CHUNK)
        .agg(*[pick(row(cols)).alias(name) for name, _, pick, cols in sides])
        .select(
            *keys,
            _CHUNK,
            *[shift(name, 1).over(across).alias(f"{name}_edge") for name, shift, _, _ in sides],
        )
    )
    shifted = df.select(
        "*", *[shift(row(cols), 1).over(inside).alias(name) for name, shift, _, cols in sides]
    )
    out = _join_chunks(shifted, edges, keys)
    for name, _, _, cols in sides:
        near = F.coalesce(name, f"{name}_edge")
        for column, alias in cols.items():
            out = out.withColumn(alias, near["_at" if column == order else column])
    return out.drop(_CHUNK, *[n for name, *_ in sides for n in (name, f"{name}_edge")])


def next_value(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """``lead(order, 1) over (partition by keys order by order)`` by chunk."""
    return neighbour_values(df, keys, order, {order: out}, {})


def interpolated_percentile(df: DataFrame, column: str, p: float, bins: int = 4096) -> DataFrame:
    """One row ``value``: exact linearly interpolated percentile, nulls ignored.

    A histogram of at most ``bins`` rows finds the bin of the rank, the next one that bin's, until a
    bin holds a single value; mostly two or three aggregates, over a stage table of the column alone.
    """
    spark = df.sparkSession
    x = F.col("x")
    rows = stage(df.select(F.col(column).cast("double").alias("x")).filter(x.isNotNull()), "values")
    n, low, high = rows.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return spark.createDataFrame([(None,)], "value double")
    at = p * (n - 1)
    rank, below, after = int(at // 1), 0, high
    held = n
    while low < high:
        # halves keep the width finite
        place = F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * bins)
        found = rows.filter(x.between(low, high)).groupBy(F.least(place, F.lit(bins - 1)).alias("bin"))
        counted = found.agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for r in sorted(counted, key=lambda r: r["bin"]):
            if below + r["n"] > rank:
                break
            below += r["n"]
        after = min((s["low"] for s in counted if s["bin"] > r["bin"]), default=after)
        if (r["low"], r["high"]) == (low, high):
            raise ValueError("values must be finite")
        low, high, held = r["low"], r["high"], r["n"]
    # the next value is another one only where the rank is the last of this one
    upper = low if below + held > rank + 1 else after
    return spark.createDataFrame([(low + (upper - low) * (at - rank),)], "value double")
