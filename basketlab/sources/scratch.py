"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = getattr(spark, "_basketlab_scratch", None)
    if root is None:
        root = "file:" + tempfile.mkdtemp(prefix="basketlab-")
        spark._basketlab_scratch = root
    return root


def session_folder(spark: SparkSession) -> str:
    """This session's part of the scratch folder; the file system removes it when the
    driver's process ends."""
    folder = getattr(spark, "_basketlab_folder", None)
    root = scratch_root(spark).rstrip("/")
    if folder is None or not folder.startswith(f"{root}/"):
        folder = f"{root}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        spark._basketlab_folder = folder
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back.

    Cuts the lineage of a table that several branches of a plan use, survives
    lost executors, and gives the optimizer the real size, so that its
    broadcast choice rests on a measured number.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
