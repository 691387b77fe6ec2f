"""Session-level helpers: the shared work folder, staged tables and text-safe settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset and the master is local (as in
    tests) a temporary folder is made and set for the session; on a cluster it would be another folder on every machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gridweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors: later jobs read files that every executor sees. Column names must be
    unique. The schema is carried over, so that an empty table keeps its columns.
    """
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in this application's part of the shared folder, which ``purge`` deletes."""
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def drop(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read any more. Results that depend on it must have been written."""
    spark = df.sparkSession
    own = f"/staged/{spark.sparkContext.applicationId}/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def purge(spark: SparkSession) -> None:
    """Delete what this application has staged. Results that read from it must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
