"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.sources.scratch import materialize


def _to_minimum(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per left node its smallest right node or itself; only totals are shuffled by node."""
    low = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return low, edges.join(low, "a")


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of `links` (a, b: long): the smallest node it reaches.

    Alternating star contraction: a large step hangs a node's larger neighbours on
    its smallest one, a small step its smaller neighbours. The pairs shrink to one
    star per component in few rounds; each round is written to the shared folder,
    so a lost executor costs that round only. Nodes with many neighbours meet only
    in a partial minimum and in a join whose other side has one row per node, which
    adaptive execution splits. Null ends and loops are no links.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = materialize(links.where("a is not null and b is not null and a <> b").distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        _, large = _to_minimum(both)
        large = large.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low, small = _to_minimum(large)
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        links = materialize(small, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
