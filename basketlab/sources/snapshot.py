"""The nested result document: written by a run, read by the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(document: DataFrame, path: str) -> None:
    """`document` has one row; nulls are kept so that the shape stays stable."""
    document.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    """The document, or no row unless the run succeeded and has a portfolio."""
    return (
        spark.read.schema(schema)
        .option("mode", "DROPMALFORMED")
        .json(path)
        .where("success AND portfolio IS NOT NULL")
    )


def publish(document: DataFrame, root: str, version: int) -> None:
    """Adds a version of the document (one row) beside the earlier ones.

    It is one file, which the committer renames into place: a reader sees the version
    whole or not at all, and a retry of the same version replaces it.
    """
    path = f"{root}/version={version}"
    document.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_current(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest version that succeeded and has a portfolio, or no row."""
    rows = spark.read.schema(f"{schema}, version INT").option("mode", "DROPMALFORMED").json(root)
    usable = rows.where("success AND portfolio IS NOT NULL")
    newest = usable.agg(F.max("version")).scalar()
    return usable.where(F.col("version") == newest).drop("version")


def read_meta(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path).select(
        "date", "elapsed_seconds", "backend_version", "run_type"
    )


def research_of(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(F.col("portfolio.research.*"))
