"""Vectors of a table, each different one once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlab.llm.common import ship
from basketlab.sources.scratch import materialize


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vec, ok. Not ok: null, empty or zero vectors, those with a null or
    non-finite component, and those of another length than the commonest one."""
    ship(df.sparkSession)
    v = F.col(f"`{vector}`")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.coalesce((F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", good)
    common = rows.where("ok").groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return rows.withColumn("ok", F.col("ok") & (F.size("vec") == (common["n"] if common else -1)))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """c (a number), vec, least (smallest id), m (rows) of each different usable vector."""
    found = rows.where("ok").groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("m"))
    return materialize(found.withColumn("c", F.monotonically_increasing_id()), "vectors")


def sample(classes: DataFrame, size: int, seed: int) -> np.ndarray:
    """At most `size` different vectors, by hash, on the driver."""
    part = classes.select("vec", F.xxhash64("vec", F.lit(seed)).alias("h")).orderBy("h").limit(size).select("vec")
    return matrix(part.toArrow().column("vec"))
