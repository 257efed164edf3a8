"""Where intermediate and stored tables live: a folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_FILE = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it names none, a new one of this machine, but only if
    driver and executors are one process: on a cluster each machine would see its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tallyforge-")
        sc.setCheckpointDir(named)
    return named


def new_dir(spark: SparkSession, name: str = "work") -> str:
    return f"{shared_dir(spark).rstrip('/')}/tallyforge-{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written to the shared folder. They cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self._n = spark, new_dir(spark), 0

    def save(self, df: DataFrame, rows: int | None = None, by: str | None = None) -> DataFrame:
        """The table, written and read back. ``rows``, a bound on its rows where one is known, keeps it from being written as
        many small files: it's then cut into no more parts than cores, or than it takes to hold ROWS_PER_FILE rows each. With
        ``by``, rows of each value of that column are in a folder of their own, so that a filter on it reads no others."""
        if rows is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE)))
        self._n += 1
        path = f"{self.root}/{self._n:03d}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads."""
        for df in tables:
            self._remove(df._scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables of this folder but these, which the result still reads."""
        kept = {df._scratch_path for df in tables}
        for i in range(1, self._n + 1):
            if (path := f"{self.root}/{i:03d}") not in kept:
                self._remove(path)

    def finish(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """The table as ``save`` gives it, and all others of this folder removed: for results that read nothing else any more."""
        out = self.save(df, rows)
        self.keep(out)
        return out

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
