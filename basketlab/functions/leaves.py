"""Any nested document as rows of (path, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def depth(kind: T.DataType) -> int:
    """How many levels of fields, elements or entries a type has."""
    if isinstance(kind, T.StructType):
        return 1 + max((depth(f.dataType) for f in kind), default=0)
    if isinstance(kind, T.ArrayType):
        return 1 + depth(kind.elementType)
    if isinstance(kind, T.MapType):
        return 1 + depth(kind.valueType)
    return 0


def leaves(documents: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, text, number) of every leaf of the other columns of `documents`.

    A path begins with $; fields and map entries (of string keys) add .name, elements
    [position]. Strings and booleans are texts, numbers are numbers, a null is neither.
    Empty lists and maps have no leaf. Each level is one `variant_explode` of the level
    above, as many as the schema has: rows spread by document and branch, and no part of a
    document is gathered again.
    """
    spark = documents.sparkSession
    body = [c for c in documents.columns if c not in keys]
    whole = F.struct(*[F.col(f"`{c}`") for c in body])
    rows = documents.select(*keys, F.lit("$").alias("path"), F.to_variant_object(whole).alias("node"))
    kind: Column = F.schema_of_variant("value")
    inner = kind.startswith("OBJECT<") | kind.startswith("ARRAY<")
    word = kind.isin("STRING", "BOOLEAN")
    step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(
        F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))
    )
    found = None
    for _ in range(depth(documents.select(*body).schema)):
        below = rows.lateralJoin(spark.tvf.variant_explode(F.col("node").outer())).select(
            *keys, F.concat("path", step).alias("path"), "value", inner.alias("inner"), word.alias("word"), (kind == "VOID").alias("void")
        )
        ends = below.where(~F.col("inner")).select(
            *keys,
            "path",
            F.when(F.col("word"), F.variant_get("value", "$", "string")).alias("text"),
            F.when(~F.col("word") & ~F.col("void"), F.try_variant_get("value", "$", "double")).alias("number"),
        )
        found = ends if found is None else found.unionByName(ends)
        rows = below.where("inner").select(*keys, "path", F.col("value").alias("node"))
    return found
