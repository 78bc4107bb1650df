"""Intermediate tables in the folder that driver and executors share.

Phases that are read more than once are cut here: they are written as Parquet
and read back, so a lost executor costs a re-read instead of a recomputed
lineage, and the reader may split skewed join partitions (AQE only does so for
plain shuffles under a join).
"""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.scratch import delete, shared_folder


class Workspace:
    """A folder of named Parquet tables that belong to one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: set[str] = set()
        atexit.register(self._quiet_drop)

    def save(self, df: DataFrame, name: str | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name or 'table'}"
        df.write.parquet(path)
        self._paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._meshlake_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later phase reads."""
        for table in tables:
            delete(self.spark, table._meshlake_path)
            self._paths.discard(table._meshlake_path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        kept = {t._meshlake_path for t in tables}
        for path in self._paths - kept:
            delete(self.spark, path)
        self._paths &= kept
        self.release()

    def release(self) -> None:
        """Let Spark delete shuffle files of finished phases now, not at some later collection."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _quiet_drop(self) -> None:
        try:
            delete(self.spark, self.path)
        except Exception:  # the session may be gone at exit
            pass
