"""Session helpers: table access and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for what a job writes for itself: the one that the cluster names in spark.checkpoint.dir.

    Where that is unset, a session on one machine gets a temporary one; on a cluster it's
    an error, as its executors share no such folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="marula-")
            _delete_at_end(spark, folder)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM delete a path, which must exist, when it ends."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of df through reliable files in the shared folder, which outlive an executor.

    For results of joins and aggregates: the last stage runs twice, which is cheap there.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same by a table written to the shared folder, for results that are costly row by row, as they're computed once.

    Its size is known to the optimiser. It's deleted when the session's driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
