"""Runs of whole lists of experiments that can be stopped at any time and started again.

The unit of work is a cell: one gap of one run.  Each of its tables is one partition,
``table/run=.../gap=...``, overwritten as a whole, and the ledger gets its row when
all are written.  A cell in the ledger with the same settings is not done
again; one that was interrupted is, over what it left.  Readers see finished cells only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..session import stage_dir
from .experiment import Experiment, Inputs, cross_system_runs, run_cross_system, run_single_system, single_system_runs

LEDGER = "run string, gap double, settings string, tables array<string>"


@dataclass(frozen=True)
class Listed:
    """A run and whether it tests on the other system."""

    run: Experiment
    cross: bool

    @property
    def name(self) -> str:
        return f"{'cross' if self.cross else 'single'}-{self.run.name}"

    @property
    def settings(self) -> str:
        """Digest of all settings but the gaps, and of the gap that holdouts are drawn on."""
        own = {k: v for k, v in vars(self.run).items() if k != "gaps"}
        return hashlib.sha256(repr((self.cross, sorted(own.items()), self.run.gaps[0])).encode()).hexdigest()


def listed_runs() -> list[Listed]:
    """All 28 runs."""
    return [Listed(r, False) for r in single_system_runs()] + [Listed(r, True) for r in cross_system_runs()]


class Campaign:
    """Result tables and saved models below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{stage_dir(spark)}/campaign").rstrip("/")

    def _path(self, table: str, run: str, gap: float) -> str:
        return f"{self.root}/{table}/run={run}/gap={gap}"

    def ledger(self) -> DataFrame:
        """Finished cells; empty before the first."""
        try:
            found = self.spark.read.option("basePath", f"{self.root}/ledger").parquet(f"{self.root}/ledger")
        except AnalysisException:
            return self.spark.createDataFrame([], LEDGER)
        return found.select("run", F.col("gap").cast("double").alias("gap"), "settings", "tables")

    def finished(self) -> set[tuple[str, float, str]]:
        return {(r["run"], r["gap"], r["settings"]) for r in self.ledger().collect()}  # a row a cell

    def run(self, runs: Iterable[Listed], inputs: Inputs, most: int | None = None) -> int:
        """Do the cells that are not finished, ``most`` of them at most; how many were done."""
        done, known = 0, self.finished()
        for listed in runs:
            for gap in map(float, listed.run.gaps):
                if (listed.name, gap, listed.settings) in known:
                    continue
                if most is not None and done >= most:
                    return done
                self._do(listed, gap, inputs)
                done += 1
        return done

    def _do(self, listed: Listed, gap: float, inputs: Inputs) -> None:
        work = run_cross_system if listed.cross else run_single_system
        tables = work(listed.run, inputs, [gap])
        for name, df in tables.items():
            df.drop("gap").write.mode("overwrite").parquet(self._path(name, listed.name, gap))
        row = self.spark.createDataFrame([(listed.settings, sorted(tables))], "settings string, tables array<string>")
        row.coalesce(1).write.mode("overwrite").parquet(self._path("ledger", listed.name, gap))

    def table(self, name: str, run: str | None = None) -> DataFrame:
        """One result table of all finished cells that have it, or of one run."""
        cells = self.ledger().where(F.array_contains("tables", name))
        if run is not None:
            cells = cells.where(F.col("run") == run)
        # partitions named one by one: those of unfinished cells are never opened
        paths = [self._path(name, r["run"], r["gap"]) for r in cells.select("run", "gap").collect()]
        if not paths:
            raise LookupError(f"no finished cell has a table {name!r}")
        df = self.spark.read.option("basePath", f"{self.root}/{name}").option("mergeSchema", True).parquet(*paths)
        return df.withColumn("gap", F.col("gap").cast("double"))
