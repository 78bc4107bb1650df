"""Intermediate tables in the folder that driver and executors share, and what needs them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Temporary folders of local applications without ``spark.checkpoint.dir``, by application.
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, in local mode only, a temporary
    folder for each application, deleted at its end."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _FOLDERS:
        made = _FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="meshlake-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return _FOLDERS[context.applicationId]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, wherever it is stored."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session may be gone at exit
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete_quietly, spark, path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows, written to the shared folder and read back: a lost executor costs a re-read,
    and a loop over tables keeps short plans."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._meshlake_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        _delete_quietly(table.sparkSession, table._meshlake_path)


def numbered(rows: DataFrame, order: Sequence[Column], output: str) -> DataFrame:
    """Adds the dense number, from 0, of each row in the given order, without a task that sees
    all rows: range partitions are sorted and numbered inside, and start where the counts of
    those before end."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("p")).count().orderBy("p").collect()  # a row for each range partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r["p"], total))
        total += r["count"]
    table = rows.sparkSession.createDataFrame(starts, "_p long, _from long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(table), part == F.col("_p")).withColumn(output, F.col("_from") + inside).drop("_p", "_from", "_at")
