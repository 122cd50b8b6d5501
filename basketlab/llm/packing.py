"""Packing by power-of-two decomposition (operator 7).

A document's ids (its tokens, then the end id 0) are split into binary-length pieces:
as many of `LONGEST` = 1024 as fit, then one of each power of two in the rest's binary
form, longest first. Every piece is a sequence of its own, so no sequence crosses
documents and none needs padding: its length is a power of two. Sequences of equal
length form a bucket from which batches are drawn; ids of sequences are dense and
ordered by bucket, longest first.

Scale: tokenizing is one pass that keeps only counts and checksums (or the ids, if
asked for); pieces are numbered by counts per bucket and partition, of which there are
11 times the partitions; no row is gathered with others.

Defined cases: a null or empty text is the end id alone, one piece of length 1;
repeated rows are packed each, a null id is kept as null; an empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.llm import common
from basketlab.llm.prefix import offsets
from basketlab.llm.tokens import encoder, vocabulary
from basketlab.sources.scratch import materialize

VOCABULARY = "byte_bpe_50k.json"
END = (0).to_bytes(4, "little")
LONGEST = 1024


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Binary lengths that add up to n, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and its ids
    (little-endian unsigned 32-bit) if asked for."""
    added = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    added += [T.StructField("ids", T.BinaryType())] * with_ids

    def make():
        def work(texts):
            index, rows = [], []
            for i, ids in enumerate(encoder(path, False).encode(texts)):
                data, at = ids + END, 0
                total = len(data) // 4
                for n in lengths(total):
                    piece = data[4 * at : 4 * (at + n)]
                    index.append(i)
                    rows.append((at, n, zlib.crc32(piece), total, piece))
                    at += n
            columns = list(zip(*rows)) if rows else [()] * 5
            return index, *columns[: len(added)]

        return work

    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return common.explode_rows(rows, "text", ["doc_id"], T.StructType(added), make)


def pack(found: DataFrame) -> DataFrame:
    """`found` (pieces) with sequence_id and offset.

    The pieces are written once; a sequence's id is the number of pieces in longer
    buckets, of its bucket in earlier partitions, and before it in its partition.
    """
    rows = found.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    rows = materialize(rows, "pieces")
    counts = rows.groupBy("length", "__part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("__order", F.row_number().over(Window.orderBy(F.desc("length"), "__part")))
    counts = offsets(counts, "__order", "n", "before").select("length", "__part", "before")
    within = F.row_number().over(Window.partitionBy("__part", "length").orderBy("__at"))
    # one row per bucket and partition; partitions spread the common lengths
    numbered = rows.withColumn("__n", within).join(counts, ["length", "__part"])
    return numbered.withColumn("sequence_id", F.col("before") + F.col("__n") - 1).withColumn("offset", F.lit(0).cast("long")).drop("__part", "__at", "__n", "before", "__order")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    found = pieces(common.table(spark, sf_dir, "documents"), vocabulary(VOCABULARY))
    return pack(found).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
