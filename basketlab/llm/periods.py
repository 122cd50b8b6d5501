"""Runs of repeated words by internal pattern matching (operator 11).

A run is a stretch of consecutive words with smallest period q (words q apart are the
same) and at least max(`LEAST`, 2q) words that no neighbour extends.

All texts of a slice are one sequence of word numbers in which no word of one text
equals one of another. Prefix doubling sorts its suffixes; each round's classes (equal
beginnings of 2^k words) are kept, so any two positions' common extension is found by
descending rounds. Blocks of L = 2^k words begin at every L/2-th word; a run of period
1.5L-1 to 3L-2 (1 to 10 for L = 4) holds such a block and its next copy one period
later. The suffixes that begin with a block are an interval of the suffix array, and a
wavelet matrix over that array answers range successor queries: the block's copies in
the window after it, cut into parts of at most L places. In such a part the copies are
one arithmetic progression, known from its first two members and their number. A
progression within the block's own periodic stretch belongs to a shorter period and is
dropped; every other member gives a candidate period, which is extended both ways and
kept if long enough. Of equal stretches the least period stays.

All steps are numpy operations over all blocks of a level at once. A level's windows
hold at most 3 places per word, so candidates are at most 3 n a level, n log n in all.

Scale: one pass over the texts without a shuffle; memory is linear in a slice's words,
of which texts without equal four-word blocks are left out at once.

Defined cases: null or empty texts have no words, no run, and an empty collapsed text;
repeated rows are treated alike; a null id draws no planted repetition; an empty table
gives no rows. Extra columns are kept by `with_runs` (one named like its results is
replaced) and ignored by the query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.llm import common

LEAST = 12  # words of the shortest run
FIRST = 4  # words of the smallest blocks
_WHITE = "[\\x20\\x09-\\x0D]+"


class Suffixes:
    """Suffix array of a sequence of positive numbers and its doubling classes.

    classes[k][i] is the place in the suffix array of the first suffix whose first 2^k
    numbers are those at i. Beyond the end follows a mark smaller than any number.
    """

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        self.array = np.argsort(numbers, kind="stable")
        ordered = numbers[self.array]
        heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        rank = np.empty(n, dtype=np.int64)
        rank[self.array] = np.repeat(heads, np.diff(np.append(heads, n)))
        self.classes = [rank]
        width = 1
        while True:
            # only suffixes that aren't alone in their class can move
            at = np.flatnonzero(self._shared(rank))
            if not len(at):
                break
            members = self.array[at]
            after = members + width
            key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            order = np.lexsort((key, rank[members]))
            members, key = members[order], key[order]
            self.array[at] = members
            group = rank[members]
            new = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
            rank = rank.copy()
            # a group's places are consecutive, so the place of a head is its class
            rank[members] = at[np.flatnonzero(new)][np.cumsum(new) - 1]
            self.classes.append(rank)
            width *= 2

    def _shared(self, rank: np.ndarray) -> np.ndarray:
        """Of each place of the array, whether its class has other members."""
        ordered = rank[self.array]
        same = ordered[1:] == ordered[:-1]
        return np.append(False, same) | np.append(same, False)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i and from j on are the same (i differs from j)."""
        n, found = len(self.array), np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.classes) - 1, -1, -1):
            a, b = i + found, j + found
            inside = (a < n) & (b < n)
            same = inside & (self.classes[k][np.where(inside, a, 0)] == self.classes[k][np.where(inside, b, 0)])
            found += same << k
        return found

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers before i and before j are the same."""
        found = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.classes) - 1, -1, -1):
            a, b = i - found - (1 << k), j - found - (1 << k)
            inside = (a >= 0) & (b >= 0)
            same = inside & (self.classes[k][np.where(inside, a, 0)] == self.classes[k][np.where(inside, b, 0)])
            found += same << k
        return found


class Wavelet:
    """A wavelet matrix over numbers up to their count (as bounds are); all queries are
    over arrays of ranges [lo, hi)."""

    def __init__(self, values: np.ndarray):
        self.planes = max(1, int(len(values)).bit_length())
        self.ones, self.zeros = [], []
        row = values
        for p in range(self.planes - 1, -1, -1):
            bits = (row >> p) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]).astype(np.int32))
            self.zeros.append(int(len(row) - self.ones[-1][-1]))
            row = np.concatenate([row[bits == 0], row[bits == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each range are smaller than its bound."""
        found = np.zeros(len(lo), dtype=np.int64)
        for p, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            one = (bound >> (self.planes - 1 - p) & 1).astype(bool)
            found += np.where(one, hi - lo - (b - a), 0)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return found

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each range."""
        value = np.zeros(len(lo), dtype=np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            few = hi - lo - (b - a)
            one = k >= few
            k = np.where(one, k - few, k)
            value = value << 1 | one
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return value

    def successors(self, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the values in [start, end) of each range: how many, the first, the second
        (0 where there is none)."""
        before = self.below(lo, hi, start)
        count = self.below(lo, hi, end) - before
        first, second = np.zeros((2, len(lo)), dtype=np.int64)
        some, more = count > 0, count > 1
        first[some] = self.kth(lo[some], hi[some], before[some])
        second[more] = self.kth(lo[more], hi[more], before[more] + 1)
        return count, first, second


def _candidates(s: Suffixes, w: Wavelet, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of a block of 2^k numbers, candidate period), for all blocks."""
    n, size = len(s.array), 1 << k
    rank = s.classes[k]
    heads = rank[s.array]
    blocks = np.arange(0, n - size + 1, size // 2)
    lo = rank[blocks]
    hi = np.searchsorted(heads, lo, side="right")
    shared = hi - lo > 1
    blocks, lo, hi = blocks[shared], lo[shared], hi[shared]
    least, most = (1 if size == FIRST else 3 * size // 2 - 1), 3 * size - 2
    at, periods = [], []
    for start in range(least, most + 1, size):
        end = np.minimum(blocks + min(start + size, most + 1), n)
        count, first, second = w.successors(lo, hi, np.minimum(blocks + start, n), end)
        one = (count == 1) | (count == 2)
        at.append(blocks[one])
        periods.append(first[one] - blocks[one])
        two = count == 2
        at.append(blocks[two])
        periods.append(second[two] - blocks[two])
        many = count > 2
        if many.any():
            b, f, d, c = blocks[many], first[many], (second - first)[many], count[many]
            # the copies' own stretch of period d; in the block's stretch, no other period
            away = b + d + s.ahead(b, b + d) < f + size
            b, f, d, c = b[away], f[away], d[away], c[away]
            step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            at.append(np.repeat(b, c))
            periods.append(np.repeat(f - b, c) + step * np.repeat(d, c))
    return np.concatenate(at), np.concatenate(periods)


def find_runs(numbers: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of positive numbers, by
    start and period."""
    if not len(numbers):
        return np.zeros((0, 3), dtype=np.int64)
    s = Suffixes(numbers)
    w = Wavelet(s.array)
    found = []
    # the last classes have one member each
    for k in range(FIRST.bit_length() - 1, len(s.classes) - 1):
        at, period = _candidates(s, w, k)
        b, f = s.behind(at, at + period), s.ahead(at, at + period)
        length = b + f + period
        long = length >= np.maximum(LEAST, 2 * period)
        if long.any():
            found.append(np.unique(np.column_stack([at - b, length, period])[long], axis=0))
    if not found:
        return np.zeros((0, 3), dtype=np.int64)
    rows = np.unique(np.concatenate(found), axis=0)  # by start, length, period
    rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Runs of each text, a list of words."""
    known: dict[bytes, int] = {}
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    numbers = np.fromiter((known.setdefault(x, len(known)) for t in texts for x in t), dtype=np.int64, count=int(lengths.sum()))
    text = np.repeat(np.arange(len(texts)), lengths)
    numbers = numbers + text * (len(known) + 1) + 1
    out = [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    # a run holds equal beginnings
    wanted = np.unique(text[_repeated(numbers)])
    if len(wanted):
        chosen = np.isin(text, wanted)
        rows = find_runs(numbers[chosen])
        begins = np.cumsum(lengths[wanted]) - lengths[wanted]
        owner = np.searchsorted(begins, rows[:, 0], side="right") - 1
        cuts = np.searchsorted(owner, np.arange(len(wanted) + 1))
        for i, t in enumerate(wanted):
            out[t] = rows[cuts[i] : cuts[i + 1]] - [begins[i], 0, 0]
    return out


def _repeated(numbers: np.ndarray) -> np.ndarray:
    """Positions whose first `FIRST` numbers are also at another position."""
    n = len(numbers) - FIRST + 1
    if n < 2:
        return np.zeros(0, dtype=np.int64)
    mixed = np.zeros(n, dtype=np.uint64)
    for j in range(FIRST):
        mixed = (mixed ^ numbers[j : n + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    return order[np.append(False, same) | np.append(same, False)]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_ADDED = T.StructType([T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])


def with_runs(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """`df` with runs (an array of start, length, period by start and period) and
    collapsed (the text's words without repetitions) of its text column."""

    def make():
        def work(texts):
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
            found = runs_of(words)
            listed = [[dict(zip(("start", "length", "period"), r)) for r in rows.tolist()] for rows in found]
            return listed, [collapse(w, r).decode("utf-8", "surrogatepass") for w, r in zip(words, found)]

        return work

    return common.append(df, text, _ADDED, make, keep_text)


def planted(documents: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document, drawn by its hashed id, ends in a repetition."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), _WHITE), lambda x: x != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = documents.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    # null for other documents, so that only a tenth is split
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.pmod("g", F.col("n"))).cast("int"))
    rows = rows.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    unit = F.slice("words", F.col("a") + 1, F.least("p", rest))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli) and
    digests of all runs and of the collapsed text, after the contract's planting."""
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_runs(planted(documents), keep_text=False)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
