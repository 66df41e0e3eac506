"""Delimited text, word lists and partitioned stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_delimited(df: DataFrame, path: str, sep: str = ";", mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def read_delimited(
    spark: SparkSession, path: str, schema: str, sep: str = ";", header: bool = True
) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", header)
        .option("sep", sep)
        .option("escape", '"')
        .csv(path)
    )


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """One entry per line."""
    return spark.read.text(path).select(F.col("value").alias("word"))


def read_column(spark: SparkSession, path: str, sep: str, position: int) -> DataFrame:
    """One column, by position, of a headerless delimited file."""
    parts = F.split(F.col("value"), F.lit("[" + sep + "]"))
    return spark.read.text(path).select(F.get(parts, F.lit(position)).alias("text"))


def write_words(words: DataFrame, path: str, mode: str = "error") -> None:
    words.select("word").write.mode(mode).text(path)


def write_window(
    events: dict[str, DataFrame], path: str, lo: int, hi: int, mode: str = "overwrite"
) -> None:
    """Window extracts of all sources in one table, partitioned by source and window.

    Overwriting replaces these sources' extracts of this window and no other.
    """
    for name, df in events.items():
        tagged = df.withColumn("source", F.lit(name)).withColumn("window", F.lit(f"{lo * 24}to{hi * 24}hrs"))
        write_partitioned(tagged, path, ["source", "window"], mode)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "error") -> None:
    """Stage table partitioned on disk by a few-valued column (unit, method).

    Overwriting replaces the partitions that ``df`` has rows of.
    """
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_partition(spark: SparkSession, path: str, **equals: str) -> DataFrame:
    """Stage table pruned to the given partition values."""
    df = spark.read.parquet(path)
    for column, value in equals.items():
        df = df.filter(F.col(column) == value)
    return df


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(fs.makeQualified(jpath).suffix("/_SUCCESS")))


def load_or_make(spark: SparkSession, path: str, make) -> DataFrame:
    """A finished table at ``path``, made and written first if absent."""
    if not _exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
