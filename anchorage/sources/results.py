"""Result tables of an experiment, one folder each, partitioned by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def save_results(tables: dict[str, DataFrame], path: str, run: str, mode: str = "append") -> None:
    for name, df in tables.items():
        df.withColumn("run", F.lit(run)).write.mode(mode).partitionBy("run").parquet(
            f"{path}/{name}"
        )


def load_results(spark: SparkSession, path: str, name: str, run: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/{name}")
    return df.filter(F.col("run") == run) if run else df


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
