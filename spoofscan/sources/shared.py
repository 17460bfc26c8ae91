"""Tables that are written once to the folder which the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables that `materialise` wrote, for `release`.
_FOLDERS: WeakKeyDictionary = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where it is unset and everything runs on this machine, a folder of our own."""
    sc, where = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    where = where or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spoofscan-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts lineage, survives a lost executor.

    With `free`, the driver collects its garbage, upon which Spark removes the shuffle files of finished jobs.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if free:
        gc.collect()
        spark._jvm.System.gc()
    stored = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[stored] = path
    return stored


def release(*tables: DataFrame) -> None:
    """Remove the folders of materialised tables that nothing reads any more."""
    for table in tables:
        path = _FOLDERS.pop(table, None)
        if path:
            drop_path(table.sparkSession, path)


def stored_bytes(table: DataFrame) -> int:
    """The bytes of a materialised table's files."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
