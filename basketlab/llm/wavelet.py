"""Token ids as one wavelet matrix per shard (operator 9).

Documents are tokenized in ascending id order, an end id after each, and cut into
shards of whole documents. A shard is one compressed file: a header, the documents'
ids (differences; a null id is a flag) and lengths, and bit-planes, most significant first, each stably partitioned by
the one above. A plane is cut into chunks that are compressed on their own and listed
with the number of ones before them, so rank and select open one chunk per plane. A
shard answers, without being decoded: the token at a position, how often a token
occurs before a position, where its k-th occurrence is; or it is decoded whole.

Files are rows of a table (one row a shard, in a column of bytes): Spark commits them
on any store, and a lost executor's shards are written again.

Scale: documents are dealt by id ranges; a shard is closed after `SHARD` tokens, so
memory is bounded by that and the longest document. Positions over the whole corpus
are running totals of one number per shard.

Defined cases: null or empty text is the end id alone; equal ids are ordered by text;
null ids come first; an empty table gives no shards. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm import common
from basketlab.llm.prefix import offsets
from basketlab.llm.tokens import encoder, vocabulary
from basketlab.sources.scratch import materialize

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SHARD = 1 << 21
CHUNK = 1 << 17  # bits of a plane compressed together
MAGIC = b"WVM1"
_HEAD = struct.Struct("<4sBIII")  # magic, planes, tokens, documents, bytes of the document list


def build(tokens: np.ndarray, doc_lengths: np.ndarray, doc_ids: list[int | None] | None = None) -> bytes:
    """The shard's file. tokens: unsigned; of each document its tokens' number and its
    id (0, 1, ... if not given)."""
    doc_ids = range(len(doc_lengths)) if doc_ids is None else doc_ids
    n = len(tokens)
    planes = max(1, int(tokens.max()).bit_length()) if n else 1
    pack = zstandard.ZstdCompressor(level=1).compress
    real = np.array([d is not None for d in doc_ids], dtype=bool)
    # differences wrap around, and so does their running sum
    steps = np.diff(np.array([d or 0 for d in doc_ids], dtype=np.int64).view(np.uint64), prepend=np.uint64(0))
    documents = pack(doc_lengths.astype("<u4").tobytes() + steps.astype("<u8").tobytes() + real.tobytes())
    directory, body = [], []
    row = tokens.astype(np.uint32 if planes > 16 else np.uint16)
    for p in range(planes - 1, -1, -1):
        ones = (row & row.dtype.type(1 << p)) != 0
        bits = np.packbits(ones, bitorder="little")
        before = 0
        for at in range(0, len(bits), CHUNK // 8):
            part = bits[at : at + CHUNK // 8]
            data = pack(part.tobytes())
            directory.append((before, len(data)))
            body.append(data)
            before += int(np.bitwise_count(part).sum(dtype=np.int64))
        if p:  # nothing stands below the last plane
            below = np.empty_like(row)
            np.compress(~ones, row, out=below[: n - before])
            np.compress(ones, row, out=below[n - before :])
            row = below
    listed = np.array(directory, dtype="<u4").tobytes()
    return b"".join([_HEAD.pack(MAGIC, planes, n, len(doc_lengths), len(documents)), documents, listed, *body])


class Shard:
    """Reads a shard's file."""

    def __init__(self, data: bytes):
        magic, self.planes, self.n, docs, size = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        self._open = zstandard.ZstdDecompressor().decompress
        at = _HEAD.size
        held = self._open(data[at : at + size])
        if len(held) != 13 * docs:
            raise ValueError("damaged list of documents")
        self.doc_lengths = np.frombuffer(held, dtype="<u4", count=docs)
        self.doc_ids = np.cumsum(np.frombuffer(held, dtype="<u8", count=docs, offset=4 * docs), dtype=np.uint64).view(np.int64)
        self.doc_known = np.frombuffer(held, dtype=bool, offset=12 * docs)
        at += size
        self.chunks = -(-self.n // CHUNK)
        listed = np.frombuffer(data, dtype="<u4", count=2 * self.planes * self.chunks, offset=at).reshape(self.planes, self.chunks, 2)
        at += listed.nbytes
        self._before = listed[:, :, 0].astype(np.int64)
        ends = at + np.cumsum(listed[:, :, 1].ravel(), dtype=np.int64).reshape(self.planes, self.chunks)
        self._ends, self._sizes, self._data = ends, listed[:, :, 1].astype(np.int64), data
        self._zeros = [self.n - self._rank(p, self.n) for p in range(self.planes)]

    def _chunk(self, plane: int, c: int) -> np.ndarray:
        return np.unpackbits(self._raw(plane, c), bitorder="little", count=min(CHUNK, self.n - c * CHUNK))

    def _raw(self, plane: int, c: int) -> np.ndarray:
        end = int(self._ends[plane, c])
        return np.frombuffer(self._open(self._data[end - int(self._sizes[plane, c]) : end]), dtype=np.uint8)

    def _look(self, plane: int, i: int) -> tuple[int, int]:
        """(ones before position i, the bit there; 0 at the end) of a plane: the chunk is
        opened once, whole bytes are counted as they are."""
        c = min(i // CHUNK, self.chunks - 1)
        if c < 0:
            return 0, 0
        raw, (whole, rest) = self._raw(plane, c), divmod(i - c * CHUNK, 8)
        ones = int(self._before[plane, c]) + int(np.bitwise_count(raw[:whole]).sum(dtype=np.int64))
        last = int(raw[whole]) if whole < len(raw) else 0
        return ones + (last & (1 << rest) - 1).bit_count(), last >> rest & 1

    def _rank(self, plane: int, i: int) -> int:
        """Ones before position i of a plane."""
        return self._look(plane, i)[0]

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.planes):
            ones, bit = self._look(p, i)
            i = self._zeros[p] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before `end` stand below the last plane."""
        if token >> self.planes:
            return 0, 0
        lo, hi = 0, end
        for p in range(self.planes):
            a, b = self._rank(p, lo), self._rank(p, hi)
            one = token >> (self.planes - 1 - p) & 1
            lo, hi = (self._zeros[p] + a, self._zeros[p] + b) if one else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences before position `end`."""
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        before = self._before[plane]
        if not bit:
            before = np.arange(self.chunks, dtype=np.int64) * CHUNK - before
        c = int(np.searchsorted(before, k, side="right")) - 1
        return c * CHUNK + int(np.flatnonzero(self._chunk(plane, c) == bit)[k - before[c]])

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence, from 0."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - p) & 1
            i = self._select(p, one, i - self._zeros[p] if one else i)
        return i

    def decode(self) -> np.ndarray:
        """All tokens, from the lowest plane up."""
        kind = np.uint32 if self.planes > 16 else np.uint16
        row = np.zeros(self.n, dtype=kind)
        for p in range(self.planes - 1, -1, -1):
            packed = np.concatenate([self._raw(p, c) for c in range(self.chunks)] or [np.zeros(0, np.uint8)])
            bits = np.unpackbits(packed, bitorder="little", count=self.n).view(bool)
            row[self._zeros[p] :] |= kind(1 << (self.planes - 1 - p))
            upper = np.empty_like(row)
            upper[np.flatnonzero(~bits)] = row[: self._zeros[p]]
            upper[np.flatnonzero(bits)] = row[self._zeros[p] :]
            row = upper
        return row


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """A written table of shards: part, shard (its number in its part), file. Parts
    ascend by document id, shards within."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    common.ship(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")  # spreads a repeated id over ranges
    dealt = docs.withColumn("tie", tie).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    dealt = dealt.withColumn("part", F.spark_partition_id()).select("part", "doc_id", "text")
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = "part int, shard int, file binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, ids, streams, held = 0, 0, [], [], 0

        def close():
            tokens = np.frombuffer(b"".join(streams), dtype="<u4")
            made = build(tokens, np.array([len(s) // 4 for s in streams]), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([made], pa.binary())], names=["part", "shard", "file"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            for at in range(0, batch.num_rows, common.SLICE_ROWS):
                piece = batch.slice(at, common.SLICE_ROWS)
                found = encoder(path, True).encode(piece.column(2).to_pylist())
                for doc, data in zip(piece.column(1).to_pylist(), found):
                    ids.append(doc)
                    streams.append(data + end)
                    held += len(data) // 4 + 1
                    if held >= SHARD:
                        yield close()
                        shard, ids, streams, held = shard + 1, [], [], 0
        if ids:
            yield close()

    return materialize(dealt.mapInArrow(run, schema), "shards")


def read_documents(shards: DataFrame) -> DataFrame:
    """part, shard, doc_id, start_in_shard, n_tokens, ids_crc32 of every document, all
    from the files."""
    common.ship(shards.sparkSession)
    schema = "part int, shard int, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, file in zip(*(batch.column(i) for i in range(3))):
                s = Shard(file.as_py())
                tokens = s.decode().astype("<u4")
                n = s.doc_lengths.astype(np.int64)
                ends = np.cumsum(n)
                crcs = [zlib.crc32(tokens[e - k : e]) for e, k in zip(ends, n)]
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, part.as_py(), dtype=np.int32)), pa.array(np.full(k, shard.as_py(), dtype=np.int32)), pa.array(s.doc_ids, mask=~s.doc_known), pa.array(ends - n), pa.array(n), pa.array(crcs, pa.int64())],
                    names=["part", "shard", "doc_id", "start_in_shard", "n_tokens", "ids_crc32"],
                )

    return shards.select("part", "shard", "file").mapInArrow(run, schema)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, shard, before: tokens of all earlier shards, by the files' headers."""
    # after the magic and the number of planes: four bytes, the lowest first
    digits = F.hex(F.substring("file", 6, 4))
    tokens = F.conv(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)]), 16, 10).cast("long")
    small = materialize(shards.select("part", "shard", tokens.alias("tokens")), "totals")
    parts = offsets(small.groupBy("part").agg(F.sum("tokens").alias("n")), "part", "n", "part_before").select("part", "part_before")
    from pyspark.sql import Window

    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return small.withColumn("own", F.coalesce(F.sum("tokens").over(earlier), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("own") + F.col("part_before")).alias("before"))


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """part, shard, n: how often a token occurs in each shard, without decoding it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Shard(f.as_py()).count(token) for f in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["part", "shard", "n"])

    common.ship(shards.sparkSession)
    return shards.select("part", "shard", "file").mapInArrow(run, "part int, shard int, n long")


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shards."""
    shards = write_shards(common.table(spark, sf_dir, "documents"), vocabulary(VOCABULARY))
    read = read_documents(shards).join(shard_starts(shards), ["part", "shard"])
    return read.select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
