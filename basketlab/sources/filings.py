"""Nested filing documents -> long facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.sources.schemas import FILING


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILING).option("mode", "DROPMALFORMED").json(path)


def flatten_filings(filings: DataFrame) -> DataFrame:
    """facts -> taxonomy -> concept -> units -> unit -> items, one row per item.

    `seq` is the item's position, which decides between equal filing dates.
    """
    return (
        filings.select("cik", F.explode("facts").alias("taxonomy", "concepts"))
        .select("cik", "taxonomy", F.explode("concepts").alias("concept", "node"))
        .select("cik", "taxonomy", "concept", F.explode("node.units").alias("unit", "items"))
        .select("cik", "taxonomy", "concept", "unit", F.posexplode("items").alias("seq", "it"))
        .select(
            F.col("cik").alias("entity"),
            "taxonomy",
            "concept",
            "unit",
            F.col("it.start").try_cast("date").alias("start"),
            F.col("it.end").try_cast("date").alias("end"),
            F.col("it.val").alias("val"),
            F.col("it.filed").try_cast("date").alias("filed"),
            F.col("it.form").alias("form"),
            "seq",
        )
    )


def nest_facts(facts: DataFrame, by: list[str]) -> DataFrame:
    """The inverse: filing documents, one per (entity, *by).

    `by` must keep a document small (one filing), so that a company with very
    many facts becomes many documents rather than one huge row.
    """
    item = F.struct(
        F.col("start").cast("string").alias("start"),
        F.col("end").cast("string").alias("end"),
        "val",
        F.col("filed").cast("string").alias("filed"),
        "form",
    )
    keys = ["entity", *by]
    # one shuffle of the facts serves every level below
    facts = facts.select(*keys, "taxonomy", "concept", "unit", "start", "end", "val", "filed", "form", "seq").repartition(*keys)
    in_order = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("seq"), item.alias("it")))), lambda e: e["it"]
    )
    units = facts.groupBy(*keys, "taxonomy", "concept", "unit").agg(in_order.alias("items"))
    concepts = units.groupBy(*keys, "taxonomy", "concept").agg(
        F.struct(
            F.map_from_entries(F.collect_list(F.struct("unit", "items"))).alias("units")
        ).alias("node")
    )
    taxonomies = concepts.groupBy(*keys, "taxonomy").agg(
        F.map_from_entries(F.collect_list(F.struct("concept", "node"))).alias("concepts")
    )
    return taxonomies.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("taxonomy", "concepts"))).alias("facts")
    ).select(F.col("entity").alias("cik"), "facts")
