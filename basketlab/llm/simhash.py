"""SimHash near-duplicates by multi-index hashing (operator 10).

A fingerprint has 64 bits: bit i is 1 if it is set in over half of the XXH64 values
(seed 42) of the text's word shingles. Two fingerprints link at `MAX_BITS` = 3 or
fewer differing bits. Each is cut into two 32-bit segments; of a linked pair at
least one segment differs in one bit or none, so the Hamming ball of radius 1 of
each segment is enumerated and looked up in that segment's table, and a match counts
only if the complete distance holds. Of two segments one bit apart one has the 0, so
only flips from 0 to 1 are looked up.

Scale: equal fingerprints collapse first, however many rows share one. A segment
value shared by more than `HOT` fingerprints would give pairs in the square of that
number; such buckets are compared in blocks of `BLOCK`, each of which returns only
links that connect the same parts. Nothing is capped.

Defined cases: null text is empty; a text without words has fingerprint 0 and links
like any other; repeated rows and repeated ids are rows of their own, with their
fingerprint's component; a null id gets its component but never names one. An empty
table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.llm import common
from basketlab.llm.blocks import star_links
from basketlab.llm.components import components
from basketlab.sources.scratch import materialize

MAX_BITS = 3
HOT = 128
BLOCK = 1024
SEED = 42
# of the stage that keeps one text of each group
BANDS = 16
ROWS = 5
WIDE_HOT = 32
BLOCK_SHINGLES = 2**20
_LANES = np.uint64(0x0101010101010101)
_ODD = np.array([xxhash.xxh64_intdigest(b"%d" % i, SEED) | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)


def words_of(text: str) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each shingle; of the whole sequence if it is shorter; none without words."""
    if len(words) < width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    one = xxhash.xxh64_intdigest
    return np.array([one(s, SEED) for s in shingles], dtype=np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the values."""
    counts = np.zeros(64, dtype=np.int64)
    for j in range(8):
        lanes = (h >> np.uint64(j)) & _LANES
        for at in range(0, len(lanes), 255 * 64):  # byte lanes hold up to 255 sums
            part = lanes[at : at + 255 * 64]
            sums = np.add.reduceat(part, np.arange(0, len(part), 255))
            counts[j::8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(h)).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprint(text: str, width: int) -> int:
    return majority(hashes(words_of(text), width))


def fingerprints(df: DataFrame, text: str = "text", width: int = 3, out: str = "fp", keep_text: bool = True) -> DataFrame:
    """`df` with its fingerprint as a signed long."""

    def make():
        def work(texts):
            values = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
            return (values.view(np.int64),)

        return work

    return common.append(df, text, T.StructType([T.StructField(out, T.LongType())]), make, keep_text)


def _segment(column, i: int):
    value = F.shiftrightunsigned(column, 32) if i == 0 else column.bitwiseAND(F.lit(0xFFFFFFFF))
    return value.cast("long")


def _lookups(fps: DataFrame) -> DataFrame:
    """seg, key, fp for every key of the balls: the segment and its flips from 0 to 1."""
    parts = []
    for i in (0, 1):
        s = _segment(F.col("fp"), i)
        flips = F.array(*[F.when(s.bitwiseAND(F.lit(1 << b)) == 0, s.bitwiseOR(F.lit(1 << b))) for b in range(32)])
        ball = F.explode(F.array_append(F.array_compact(flips), s))
        parts.append(fps.select(F.lit(i).alias("seg"), ball.alias("key"), "fp"))
    return parts[0].unionByName(parts[1])


def _tables(fps: DataFrame) -> DataFrame:
    parts = [fps.select(F.lit(i).alias("seg"), _segment(F.col("fp"), i).alias("key"), "fp") for i in (0, 1)]
    return parts[0].unionByName(parts[1])


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    left = pdf.loc[pdf["side"] == 0, "fp"].to_numpy(dtype=np.int64)
    right = pdf.loc[pdf["side"] == 1, "fp"].to_numpy(dtype=np.int64)
    # bits of signed numbers would be those of their absolute value
    near = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= MAX_BITS
    near &= left[:, None] != right[None, :]
    a, b = star_links(near, left, right)
    return pd.DataFrame({"a": a, "b": b})


def links(fps: DataFrame) -> DataFrame:
    """a, b (fingerprints): links whose components are those of all pairs at
    `MAX_BITS` or fewer. `fps` has one row per distinct fingerprint (fp)."""
    common.ship(fps.sparkSession)
    tables, lookups = _tables(fps), _lookups(fps)
    sizes = materialize(tables.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "hot")
    # an exploded table is taken for as small as the one it comes from: it must not be sent to the driver
    asking = lookups.withColumnRenamed("fp", "a").hint("merge")
    plain = asking.join(tables.join(sizes, ["seg", "key"], "left_anti").withColumnRenamed("fp", "b"), ["seg", "key"])
    plain = plain.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")
    if not sizes.take(1):
        return plain
    # hot buckets: both sides cut into blocks by a hash, every pair of blocks a group of its own
    asked = materialize(lookups.join(sizes, ["seg", "key"], "left_semi"), "asked")
    counts = asked.groupBy("seg", "key").agg(F.count("*").alias("m"))

    def blocks(n):
        return F.ceil(F.col(n) / BLOCK).cast("long")

    def dealt(n):
        return F.pmod(F.xxhash64("fp"), blocks(n))

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))

    sized = materialize(sizes.join(counts, ["seg", "key"]), "sized")
    left = asked.join(sized, ["seg", "key"]).select("seg", "key", dealt("m").alias("lb"), every("n").alias("rb"), F.lit(0).alias("side"), "fp")
    right = tables.join(sized, ["seg", "key"]).select("seg", "key", every("m").alias("lb"), dealt("n").alias("rb"), F.lit(1).alias("side"), "fp")
    hot = left.unionByName(right).groupBy("seg", "key", "lb", "rb").applyInPandas(_block_links, "a long, b long")
    return plain.unionByName(hot)


def classes(keyed: DataFrame) -> DataFrame:
    """fp, component for every fingerprint of `keyed` (doc_id, fp), where component is
    the smallest doc_id among all rows whose fingerprint is reachable by links."""
    fps = materialize(keyed.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    reach = components(links(fps.select("fp")))
    whole = fps.join(reach.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    whole = materialize(whole, "reach")
    least = whole.groupBy("label").agg(F.min("least").alias("component_id"))
    return whole.join(least, "label").select("fp", "component_id")


def hex16(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp, component_id for every row of `df`."""
    rows = df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    keyed = materialize(fingerprints(rows, width=width, keep_text=False), "fingerprints")
    return keyed.join(classes(keyed), "fp").select("doc_id", "fp", "component_id")


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th of independent hash functions of values that are hashes already."""
    z = h + np.uint64((n + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def band_keys(h: np.ndarray) -> np.ndarray:
    """The search keys of a set of shingles: the smallest values under `BANDS` x `ROWS`
    hash functions, `ROWS` of them in a key. Two sets alike to s have an equal key with
    probability 1 - (1 - s ** ROWS) ** BANDS, wherever the texts differ. None if empty."""
    if not len(h):
        return np.empty(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 1024):
        np.minimum(least, (h[at : at + 1024, None] * _ODD).min(axis=0), out=least)
    key = np.zeros(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = _mixed(key ^ row, 0)
    return key.view(np.int64)


def set_print(h: np.ndarray) -> np.ndarray:
    """128 bits that are equal for equal sets only, and the set's size."""
    return np.array([*np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), dtype=np.int64), len(h)])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of `left` has in common with each of `right`."""
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    values = [np.concatenate(x) for x in (left, right)]
    both = np.intersect1d(*values)
    found = np.zeros((len(left), len(right)), dtype=np.float32)  # exact up to 2 ** 24
    at = [np.searchsorted(both, v) for v in values]
    for i in (0, 1):
        known = np.isin(values[i], both)
        order = np.argsort(at[i][known], kind="stable")
        rows[i], at[i] = rows[i][known][order], at[i][known][order]
    for start in range(0, len(both), 4096):
        part = []
        for i, n in enumerate((len(left), len(right))):
            lo, hi = np.searchsorted(at[i], (start, start + 4096))
            x = np.zeros((n, min(4096, len(both) - start)), dtype=np.float32)
            x[rows[i][lo:hi], at[i][lo:hi] - start] = 1
            part.append(x)
        found += part[0] @ part[1].T
    return found.astype(np.int64)


def _set_block(similarity: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["d"] == pdf[k]] for k in ("lb", "rb")]
        c = [s["c"].to_numpy(dtype=np.int64) for s in sides]
        sets = [[np.asarray(x, dtype=np.int64) for x in s["shingles"]] for s in sides]
        if not all(sets):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        common_ = overlaps(*sets)
        n = [np.array([len(x) for x in s]) for s in sets]
        near = common_ / (n[0][:, None] + n[1][None, :] - common_) >= similarity
        a, b = star_links(near & (c[0][:, None] != c[1][None, :]), *c)
        return pd.DataFrame({"a": a, "b": b})

    return run


def print_pairs(classes: DataFrame) -> DataFrame:
    """a, an, b, bn: pairs of classes (c, fp, n) that the search by fingerprints meets: the
    classes of one fingerprint with its first, and the first ones of linked fingerprints."""
    firsts = materialize(classes.groupBy("fp").agg(F.min(F.struct("c", "n")).alias("first")), "fps")
    own = classes.join(firsts, "fp").where(F.col("c") != F.col("first.c")).select(F.col("first.c").alias("a"), F.col("first.n").alias("an"), F.col("c").alias("b"), F.col("n").alias("bn"))
    sides = [firsts.select(F.col("fp").alias(f"fp_{k}"), F.col("first.c").alias(k), F.col("first.n").alias(f"{k}n")) for k in ("a", "b")]
    linked = links(firsts.select("fp")).toDF("fp_a", "fp_b").join(sides[0], "fp_a").join(sides[1], "fp_b")
    return own.unionByName(linked.select("a", "an", "b", "bn"))


def wide_links(classes: DataFrame, sets, similarity: float) -> DataFrame:
    """a, b (class numbers): links that connect the classes which have linked fingerprints
    or share a key, and whose sets of shingles are alike to `similarity` or more, counted
    on the sets.

    classes: c, keys, fp, n (the set's size). `sets` gives c, shingles for a table of c.
    """
    common.ship(classes.sparkSession)
    bucket = Window.partitionBy("seg", "key")
    rows = classes.select("c", "n", F.posexplode("keys").alias("seg", "key"))
    rows = materialize(rows.withColumn("size", F.count("*").over(bucket)).where("size > 1").drop("size"), "buckets")

    def sizes_agree(a: str, b: str):
        return F.least(a, b) / F.greatest(a, b) >= similarity

    met = materialize(print_pairs(classes.select("c", "fp", "n")).where(sizes_agree("an", "bn")), "met")
    asked = rows.select("c").union(met.select("a")).union(met.select("b"))
    shingles = materialize(sets(asked.distinct()), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(shingles.toDF("a", "sa"), "a").join(shingles.toDF("b", "sb"), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        both = both.withColumn("shared", shared)
        return both.where(F.col("shared") / (F.size("sa") + F.size("sb") - F.col("shared")) >= similarity).select("a", "b")

    near = tried = None
    open_ = rows.withColumn("label", F.col("c"))
    # first what the fingerprints meet, then neighbours in each bucket: as many pairs as
    # rows, and dense groups hang together
    for order in (None, ["n", "c"], [F.xxhash64("c"), "c"]):
        pairs = met.withColumnRenamed("a", "c")
        if order:
            window = bucket.orderBy(*order)
            pairs = open_.withColumn("b", F.lag("c").over(window)).withColumn("bn", F.lag("n").over(window)).withColumn("bl", F.lag("label").over(window))
            pairs = pairs.where((F.col("label") != F.col("bl")) & sizes_agree("n", "bn"))
        pairs = pairs.select(F.least("c", "b").alias("a"), F.greatest("c", "b").alias("b")).distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "neighbours")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = materialize(verified(pairs), "near")
        near = links if near is None else near.unionByName(links)
        named = rows.join(components(near).withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
        apart = F.min("label").over(bucket) != F.max("label").over(bucket)
        open_ = materialize(named.withColumn("apart", apart).where("apart").drop("apart"), "open")
    # then all pairs of buckets that don't hang together yet, large ones in blocks
    sizes = open_.groupBy("seg", "key").agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    sizes = materialize(sizes.where(F.col("m") > WIDE_HOT), "hot")
    small = open_.join(sizes, ["seg", "key"], "left_anti")
    left = small.select("seg", "key", F.col("c").alias("a"), F.col("n").alias("an"), F.col("label").alias("la"))
    right = small.select("seg", "key", F.col("c").alias("b"), F.col("n").alias("bn"), F.col("label").alias("lb"))
    found = left.join(right, ["seg", "key"]).where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & sizes_agree("an", "bn"))
    found = materialize(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "candidates")
    near = near.unionByName(verified(found))
    if sizes.take(1):
        near = near.unionByName(_hot_links(open_.select("seg", "key", "c"), sizes, shingles, similarity))
    return near


def _hot_links(rows: DataFrame, sizes: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Links of the buckets in `sizes` (seg, key, m, all), compared in blocks of at most
    about `BLOCK` sets and `BLOCK_SHINGLES` values."""
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("all") / BLOCK_SHINGLES)).cast("long")
    dealt = rows.join(sizes.withColumn("blocks", blocks), ["seg", "key"])
    dealt = dealt.withColumn("d", F.pmod(F.xxhash64("c"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("seg", "key", F.least("d", "other").alias("lb"), F.greatest("d", "other").alias("rb"), "d", "c")
    return dealt.join(shingles, "c").groupBy("seg", "key", "lb", "rb").applyInPandas(_set_block(similarity), "a long, b long")


def keep_one(df: DataFrame, similarity: float = 0.8, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-copies: the one with the smallest id (a null id
    last); among equal ids any one.

    Texts link if their sets of `width`-word shingles are alike to `similarity` or more
    (common shingles by all shingles of both), counted on the sets of hashes. Pairs to
    count are first those whose fingerprints (of the sets) `links` connects. Texts alike
    to 0.8 differ in about 10 of 64 bits, beyond any ball that can be looked up; so pairs
    with an equal key of `BANDS` are counted too: each key is made of the smallest
    values of the set under `ROWS` hash functions, so that only the sets' similarity
    matters: of pairs at 0.8 it meets 998 in 1000, at 0.85 all but 1 in 10,000, whether
    single words are changed all over the text or a block is cut off, added or replaced.
    """
    keys_, print_, fp_, row_ = (common.free_name(df, n) for n in ("keys", "print", "fp", "row"))

    def make():
        def work(texts):
            sets = [np.unique(hashes(words_of(t), width)) for t in texts]
            prints = np.array([majority(h) for h in sets], dtype=np.uint64).view(np.int64)
            return [band_keys(h) for h in sets], [set_print(h) for h in sets], prints

        return work

    def make_sets():
        return lambda texts: ([np.unique(hashes(words_of(t), width)).view(np.int64) for t in texts],)

    longs = T.ArrayType(T.LongType())
    added = T.StructType([T.StructField(keys_, longs), T.StructField(print_, longs), T.StructField(fp_, T.LongType())])
    marked = common.append(df, text, added, make).withColumn(row_, F.monotonically_increasing_id())
    marked = materialize(marked, "marked")  # the row numbers must not change
    rows = marked.select(F.col(f"`{key}`").alias("id"), F.col(keys_).alias("keys"), F.col(print_).alias("print"), F.col(fp_).alias("fp"), F.col(row_).alias("row"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = rows.groupBy("keys", "print", "fp").agg(F.min(order).alias("first"))
    classes = materialize(classes.withColumn("c", F.monotonically_increasing_id()), "prints")

    def sets(of: DataFrame) -> DataFrame:
        asked = classes.join(of, "c", "left_semi").select("c", F.col("first.row").alias(row_))
        texts = marked.select(row_, F.col(f"`{text}`").alias("t")).join(asked, row_).select("c", "t")
        return common.append(texts, "t", T.StructType([T.StructField("shingles", T.ArrayType(T.LongType()))]), make_sets, False)

    links = wide_links(classes.select("c", "keys", "fp", F.col("print")[2].alias("n")), sets, similarity)
    reach = components(links).withColumnRenamed("node", "c")
    named = classes.select("c", "first").join(reach, "c", "left")
    stays = named.groupBy(F.coalesce("label", "c").alias("label")).agg(F.min("first").alias("first"))
    return marked.join(stays.select(F.col("first.row").alias(row_)), row_, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document; 3-word shingles."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
