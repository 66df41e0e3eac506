"""Session settings and the shared stage folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

# Run-time settings every plan relies on.  The skew rule is forced so that a
# join whose output partitioning feeds an aggregation is still split when one
# key is hot; without skew it adds no shuffle.  Arrow batches go by bytes: 10,000
# rows of long texts or payloads would be held whole by the JVM and the worker.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a small scan over all cores before heavy work on each row.

    A scan that already has a partition per core, as any large table has, is
    left alone and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def stage_dir(spark: SparkSession) -> str:
    """Shared folder for stage tables, as the session names it.

    A machine-local folder is made only for a local master with nothing set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="anchorage-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


# Removes the shuffle files of a query when it ends, not when the driver next collects garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, schema: T.StructType | None = None, freed: bool = False) -> DataFrame:
    """Write ``df`` once as parquet in the stage folder and read it back.

    Cuts lineage at a stage boundary with a table that outlives executors.
    ``schema`` replaces the stored types on read (used for ML vectors).  ``freed`` removes the
    shuffle files of the write at its end.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREED, "false")
    if freed:
        spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if freed:
            spark.conf.set(_FREED, before)
    return spark.read.schema(schema or df.schema).parquet(path)
