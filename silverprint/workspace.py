"""Shared scratch tables: the one place where lineage is cut.

Loops and global ranks need a fixed intermediate result. It is written as a Parquet table under
the folder named by ``spark.checkpoint.dir``, so a lost executor never loses it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

_local_dirs: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master without the setting."""
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="silverprint-")
    return _local_dirs[app]


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/silverprint/{uuid.uuid4().hex}/{label}"


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to a fresh scratch table and return a scan of it."""
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def release(table: DataFrame) -> None:
    """Delete a scratch table made by :func:`materialise` once nothing reads it any more."""
    path = getattr(table, "_scratch_path", None)
    if path is None:
        return
    spark = table.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
