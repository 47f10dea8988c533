"""Cutting lineage through storage that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where that is unset, a session whose executors are threads of one machine (tests) gets a local folder; a cluster
    gets an error, as its executors wouldn't share such a folder.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="drayline-checkpoint-")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str) -> tuple:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once into a table in the shared folder; a lost executor costs no recomputation.

    A table, unlike ``checkpoint()``, is computed in one job instead of two, and its size is known to later joins. It stays
    until :func:`release`, at the latest until the session's end, as frames that were derived from it may still be read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, there = _path(spark, path)
    files.deleteOnExit(there)
    table = spark.read.schema(df.schema).parquet(path)
    table._materialized = path
    return table


def release(*tables: DataFrame) -> None:
    """Removes tables of :func:`materialize` that no frame reads any more."""
    for table in tables:
        files, there = _path(table.sparkSession, table._materialized)
        files.delete(there, True)
        files.cancelDeleteOnExit(there)
