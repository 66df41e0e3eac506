import random

import pytest
from pyspark.sql import Window as W, functions as F

from anchorage.operators import ranking
from helpers import rows


@pytest.fixture
def skewed(frame):
    """One key holds most of the rows."""
    rng = random.Random(3)
    data = [(0 if rng.random() < 0.8 else rng.randrange(1, 9), i, rng.randrange(50)) for i in range(3000)]
    return frame(data, "g int, id int, v int")


def test_number_rows_equals_window(skewed):
    chunked = ranking.quantile_chunk(skewed, "id", 16)
    got = ranking.number_rows(chunked, ["g"], [F.col("id")], "n")
    want = skewed.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy("id")))
    assert rows(got, "g", "id", "n") == rows(want, "g", "id", "n")


def test_number_rows_without_keys(skewed):
    got = ranking.number_rows(ranking.quantile_chunk(skewed, "id", 8), [], [F.col("id")], "n")
    assert sorted(r.n for r in got.collect()) == list(range(1, 3001))


def test_hash_chunk_spreads_one_hot_key(skewed):
    hot = skewed.filter("g = 0").withColumn("d", F.md5(F.col("id").cast("string")))
    sizes = [r["count"] for r in ranking.hash_chunk(hot, "d").groupBy("_chunk").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 40


def test_running_sum_equals_window(skewed):
    unique = skewed.groupBy("g", "v").agg(F.count("*").alias("c"))
    got = ranking.running_sum(ranking.quantile_chunk(unique, "v", 7), ["g"], "v", {"c": "below"})
    w = W.partitionBy("g").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    want = unique.withColumn("below", F.coalesce(F.sum("c").over(w), F.lit(0)))
    assert rows(got, "g", "v", "below") == rows(want, "g", "v", "below")


def test_neighbours_equal_window(skewed):
    df = skewed.withColumn("at", F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(0, id)"))
    got = ranking.neighbour_values(
        ranking.time_chunk(df, "at", "day"), ["g"], "at", {"at": "nxt"}, {"v": "prev"}
    )
    w = W.partitionBy("g").orderBy("at")
    want = df.withColumn("nxt", F.lead("at").over(w)).withColumn("prev", F.lag("v").over(w))
    assert rows(got, "g", "id", "nxt", "prev") == rows(want, "g", "id", "nxt", "prev")


@pytest.mark.parametrize("p", [0.0, 0.25, 0.75, 1.0])
def test_percentile_equals_numpy(frame, p):
    import numpy as np

    rng = random.Random(5)
    values = [rng.choice([None, rng.randrange(40), 7]) for _ in range(501)]
    df = frame([(float(v) if v is not None else None,) for v in values], "x double")
    got = ranking.interpolated_percentile(df, "x", p).first()[0]
    assert got == pytest.approx(np.percentile([v for v in values if v is not None], p * 100))


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_percentile_of_few_close_and_far_values(frame, bins):
    import numpy as np

    rng = random.Random(bins)
    for values in ([3.0], [1e-300, 1e300, -1e300, 5.0], [1.0, 1.0 + 2**-52, 1.0 + 2**-51] * 3, [rng.gauss(0, 1) for _ in range(60)]):
        df = frame([(v,) for v in values], "x double")
        for p in (0.0, 0.4, 0.75, 1.0):
            got = ranking.interpolated_percentile(df, "x", p, bins).first()[0]
            assert got == pytest.approx(np.percentile(values, p * 100), rel=1e-12)


def test_percentile_without_values(frame):
    assert ranking.interpolated_percentile(frame([(None,)], "x double"), "x", 0.5).first()[0] is None
    with pytest.raises(ValueError):
        ranking.interpolated_percentile(frame([(1.0,), (float("inf"),)], "x double"), "x", 0.5)
