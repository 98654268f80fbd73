"""Tables between the rounds of iterative operators: written to the folder that driver and executors share, which cuts the lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir, as in local tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; one of this machine only where the master is local too."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_SHARED_DIR).rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str) -> DataFrame:
    """df from the shared folder, after it was written there; the files go when the driver's JVM ends, or by erased()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tributary/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _path(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def erased(df: DataFrame) -> None:
    """Deletes what written() wrote, once no later plan reads it."""
    if path := getattr(df, "_scratch_path", None):
        where, files = _path(df.sparkSession, path)
        files.delete(where, True)
