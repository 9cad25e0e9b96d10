"""Sinks. A merge never reads and overwrites one path in the same job: it writes a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_version(df: DataFrame, base: str, version: int, partition_by: tuple[str, ...] = ()) -> str:
    """Write a new version of a table and return its path."""
    path = f"{base.rstrip('/')}/v{version:08d}"
    df.write.partitionBy(*partition_by).parquet(path)
    return path


def dup_rebuild_sink(groups: DataFrame, path: str, kinds: tuple[str, ...], members: DataFrame | None = None) -> None:
    """Replace the groups of ``kinds`` at ``path/groups``, and their members (with a ``kind``) at ``path/members``.

    Each kind is a partition that is written even when nothing of it is left, so that an empty rebuild empties it. Other
    kinds stay; rows of other kinds in ``groups`` are not taken.
    """
    for name, rows in (("groups", groups), ("members", members)):
        for kind in kinds if rows is not None else ():
            rows.filter(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{path}/{name}/kind={kind}")


def operation_log_append(rows: DataFrame, path: str) -> None:
    """Append states of operations: one before anything moves, one when all is done."""
    rows.write.mode("append").parquet(path)


def operation_log_latest(log: DataFrame) -> DataFrame:
    """The last state of each operation. States per operation are few."""
    newest = Window.partitionBy("id").orderBy(F.col("logged_at").desc(), F.col("seq").desc())
    return log.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
