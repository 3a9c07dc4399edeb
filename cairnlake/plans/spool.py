"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder on a local master, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairnlake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def spool_dir(spark: SparkSession) -> str:
    """The folder of this application's tables; ``release`` deletes it."""
    return f"{shared_dir(spark)}/cairnlake/{spark.sparkContext.applicationId}"


def spool(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back; a lost executor costs no recomputation."""
    path = f"{spool_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all tables written by ``spool`` in this application. Results not yet written elsewhere cannot be read after."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(spool_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
