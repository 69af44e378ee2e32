"""Sizing and materialisation helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: session setting: partitions that the registered queries deal their scans to, round robin.
#: Unset on a cluster: there ``spark.sql.files.maxPartitionBytes`` splits a scan without a shuffle.
SPREAD = "spark.veilframe.spread"


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Deal the rows to so many partitions, round robin, if asked to.

    For a file of a single row group, which is one task however many cores there
    are. Rows of one key go everywhere, so a hot key is not one partition.
    """
    return df.repartition(partitions) if partitions else df


def asked_spread(spark: SparkSession) -> int | None:
    """``SPREAD``; unset, a local session deals out, whose inputs are single files."""
    value = spark.conf.get(SPREAD, None)
    if value:
        return int(value)
    context = spark.sparkContext
    return 4 * context.defaultParallelism if context.master.startswith("local[") else None


def several_a_core(spark: SparkSession) -> int:
    """Partitions for work that takes long in proportion to its bytes; at least those of a shuffle."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keep_last_key(spark: SparkSession) -> None:
    """JSON objects with a repeated key are valid from now on, and the last one counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without it; a cluster needs storage every executor
    can reach, which is for its operator to name.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="veilframe-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/veilframe/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a result once and read it back: its lineage ends at the shared folder,
    so lost executors do not repeat the work and every reader sees the same rows."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = _file_system(spark, path)
    return system.exists(folder)


def is_folder(spark: SparkSession, path: str) -> bool:
    system, folder = _file_system(spark, path)
    return system.exists(folder) and system.getFileStatus(folder).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that an operator of this package wrote, on whatever storage it lies."""
    system, folder = _file_system(spark, path)
    system.delete(folder, True)
