"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

import basketlab
from basketlab.sources.scratch import materialize

# Rows handed to a worker function at once: what it holds beside one Arrow batch.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Hands this package to the workers, once a session, wherever it was imported from."""
    context = spark.sparkContext
    if not getattr(context, "_basketlab_shipped", False):
        folder = os.path.dirname(os.path.abspath(basketlab.__file__))
        to = os.path.join(tempfile.mkdtemp(prefix="basketlab-"), "basketlab")
        context.addPyFile(shutil.make_archive(to, "zip", os.path.dirname(folder), os.path.basename(folder)))
        context._basketlab_shipped = True


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` hasn't got, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def append(df: DataFrame, text: str, added: T.StructType, make: Callable, keep_text: bool = True) -> DataFrame:
    """`df` with columns computed from its text column, one pass, no shuffle.

    `make()` runs once per task and gives a function from a list of texts (nulls
    as "") to one list per added column. A column of `df` that has an added name
    is replaced.
    """
    ship(df.sparkSession)
    names = {f.name for f in added} | (set() if keep_text else {text})
    if text in added.names:
        raise ValueError(f"{text} is the input column")
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + added.fields)
    target = to_arrow_schema(added)
    columns = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = [x or "" for x in part.column(len(columns)).to_pylist()]
                new = work(texts)
                arrays = [part.column(i) for i in range(len(columns))]
                arrays += [pa.array(v, type=target.field(f.name).type) for f, v in zip(added, new)]
                yield pa.RecordBatch.from_arrays(arrays, names=columns + list(added.names))

    return df.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").alias(free_name(df, "text_"))).mapInArrow(run, schema)


def explode_rows(df: DataFrame, text: str, keep: list[str], added: T.StructType, make: Callable) -> DataFrame:
    """Any number of rows per text: `make()` gives a function from a list of texts
    to (index of the text, then one list per added column), equally long."""
    ship(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    target = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                index, *new = work([x or "" for x in part.column(len(keep)).to_pylist()])
                take = pa.array(index, type=pa.int64())
                arrays = [part.column(i).take(take) for i in range(len(keep))]
                arrays += [pa.array(v, type=target.field(f.name).type) for f, v in zip(added, new)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(free_name(df, "text_"))).mapInArrow(run, schema)


def labelled_rows(documents: DataFrame, labels: DataFrame, label: str, train, per_class: int, max_chars: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """Training rows (__id, __y, __t), and how many labelled rows each class has.

    Bounded whatever the tables' size: at most `per_class` rows of each label, the
    ones whose hashed id is smallest, none longer than `max_chars` characters. Of an
    id's texts, however many rows have it, only the smallest is taken, on Spark.
    `train` is a condition on the labels' doc_id. Null labels or ids are no rows.
    """
    rows = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("__y")).where(
        F.col("doc_id").isNotNull() & F.col("__y").isin(0, 1) & train
    )
    counts = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for y in (0, 1):
        part = rows.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    # at most 2 * per_class ids, so the broadcast has a bound
    drawn = materialize(drawn, "drawn")
    drawn = drawn.withColumnRenamed("doc_id", "__id")
    texts = (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("__t"))
        .where(F.length("__t") <= max_chars)
        .join(F.broadcast(drawn.select("__id").distinct()), F.col("doc_id") == F.col("__id"))
        .groupBy("__id")
        .agg(F.min("__t").alias("__t"))
    )
    return texts.join(F.broadcast(drawn), "__id").select("__id", "__y", "__t"), counts


def labelled_sample(*args, **named) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """What `labelled_rows` gives, on the driver."""
    found, counts = labelled_rows(*args, **named)
    return [(r["__t"], r["__y"]) for r in sorted(found.collect(), key=lambda r: (r["__id"], r["__t"]))], counts
