"""Quality by a factorisation machine (operator 5).

A text's features are its hashed words (logarithms of their counts, scaled to length
1), statistics of its structure, and its length as metadata. The score is

    w0 + sum w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

that is, all pairwise interactions of rank `RANK` in time linear in the features.
Weights are trained in numpy on the driver; scoring is one pass without a shuffle.

Scale: at most `PER_CLASS` training rows of each label by hashed id, none over
`MAX_CHARS` characters; class weights restore the labels' true shares. A task's cache
of word buckets holds at most `CACHE` words.

Defined cases: a null or empty text has no words and zero statistics and gets the
score of those; with one class only in training the score is that class's share;
without training rows it is 0. Extra columns are ignored, repeated rows are scored
alike. Labels, lang, source and ids are never inputs.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.llm import common

BUCKETS = 1 << 16
RANK = 8
STEPS = 60
RATE = 0.05
DECAY = 1e-5
PER_CLASS = 2000
MAX_CHARS = 100_000
CACHE = 400_000
THRESHOLD = 0.7
SEED = 5
_EDGES = ".,;:!?\"'()[]{}<>|*-_"
#: statistics of structure, in the order `statistics` gives them
STATISTICS = (
    "length", "words", "distinct", "repeated_next", "commonest", "upper", "digits", "marks",
    "bars", "shouts", "lines", "line_repeats", "word_length", "symbols", "loudest_line", "flattest_line",
)


@dataclass(frozen=True)
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


class _Buckets(dict):
    """Hash bucket of each word."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        word = token.lower().strip(_EDGES) or token
        value = self[token] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)
        return value


_UPPER, _DIGIT, _MARK, _SYMBOL = (re.compile(p) for p in (r"[A-ZÀ-ÖØ-Þ]+", r"[0-9]+", r"[.,;:!?]+", r"[^\w\s.,;:!?]+"))


def _share(pattern, text: str) -> float:
    return sum(map(len, pattern.findall(text)))


def statistics(text: str, words: list[str], ids: np.ndarray, counts: np.ndarray) -> list[float]:
    if not words:
        return [0.0] * len(STATISTICS)
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x]
    seqs = [x.split() for x in lines]
    long = [(x, s) for x, s in zip(lines, seqs) if len(s) >= 6] or list(zip(lines, seqs))
    loud = max((sum(1 for w in s if w.isupper()) / len(s) for _, s in long if s), default=0.0)
    flat = min((len(set(s)) / len(s) ** 0.9 for _, s in long if s), default=1.0)
    same = int((ids[1:] == ids[:-1]).sum())
    return [
        np.log1p(chars), np.log1p(n), len(counts) / n, same / n, counts.max() / n,
        _share(_UPPER, text) / chars, _share(_DIGIT, text) / chars, _share(_MARK, text) / chars,
        text.count("|") / n, text.count("!") / n, np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        chars / n, _share(_SYMBOL, text) / chars, loud, flat,
    ]


def features(text: str, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets, their values, statistics."""
    words = text.split()
    ids = np.fromiter(map(buckets.__getitem__, words), dtype=np.int64, count=len(words))
    distinct, counts = np.unique(ids, return_counts=True)
    x = 1.0 + np.log(counts) if len(counts) else np.zeros(0)
    return distinct, x / max(1e-9, np.sqrt((x * x).sum())), statistics(text, words, ids, counts)


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[tuple[str, int]], counts: dict[int, int]) -> Model:
    """rows: (text, label 0 or 1); counts: labelled rows of each class in the tables."""
    width = BUCKETS + len(STATISTICS)
    y = np.array([label for _, label in rows], dtype=np.float64)
    plain = np.zeros(len(STATISTICS))
    if len(rows) == 0 or y.min() == y.max():
        w0 = 40.0 if len(rows) and y.max() == 1 else -40.0
        return Model(w0, np.zeros(width), np.zeros((width, RANK)), plain, plain + 1)
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    weight = weight / weight.sum()
    buckets = _Buckets()
    found = [features(t, buckets) for t, _ in rows]
    stats = np.array([f[2] for f in found])
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    stats = (stats - mean) / scale
    tail = np.arange(BUCKETS, width)
    idx = np.concatenate([np.append(f[0], tail) for f in found]).astype(np.int32)
    x = np.concatenate([np.append(f[1], s) for f, s in zip(found, stats)])
    size = np.array([len(f[0]) + len(tail) for f in found])
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    del found
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(width), rng.normal(0, 0.05, (width, RANK))
    w0 = np.array([np.log(counts[1] / counts[0])])
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w0, w, v)]
    square = x * x
    for step in range(1, STEPS + 1):
        sums, diagonal = np.empty((len(rows), RANK)), np.zeros(len(rows))
        for f in range(RANK):
            vx = v[idx, f] * x
            sums[:, f] = np.add.reduceat(vx, at)
            diagonal += np.add.reduceat(vx * vx, at)
        z = w0[0] + np.add.reduceat(w[idx] * x, at) + 0.5 * ((sums * sums).sum(1) - diagonal)
        g = weight * (_sigmoid(z) - y)
        gx = g[row] * x
        own = np.bincount(idx, weights=g[row] * square, minlength=width)
        dv = np.empty_like(v)
        for f in range(RANK):
            dv[:, f] = np.bincount(idx, weights=gx * sums[row, f], minlength=width) - own * v[:, f]
        grads = (np.array([g.sum()]), np.bincount(idx, weights=gx, minlength=width) + DECAY * w, dv + DECAY * v)
        for p, d, (m, s) in zip((w0, w, v), grads, state):
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Model(float(w0[0]), w, v, mean, scale)


def score_text(text: str, model: Model, buckets: _Buckets) -> float:
    ids, x, stats = features(text, buckets)
    s = np.clip((np.array(stats) - model.mean) / model.scale, -8, 8)
    w, v = model.w, model.v
    z = model.w0 + w[ids] @ x + w[BUCKETS:] @ s
    vx = np.concatenate([v[ids] * x[:, None], v[BUCKETS:] * s[:, None]])
    total = vx.sum(0)
    z += 0.5 * (total @ total - (vx * vx).sum())
    return float(_sigmoid(z))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep_text: bool = True) -> DataFrame:
    """`df` with the score of its text column."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        buckets = _Buckets()
        return lambda texts: ([score_text(t, shared.value, buckets) for t in texts],)

    return common.append(df, text, T.StructType([T.StructField(out, T.DoubleType())]), make, keep_text)


def held_out():
    """Rows whose labels are never learned."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def train(documents: DataFrame, labels: DataFrame) -> Model:
    rows, counts = common.labelled_sample(documents, labels, "quality", ~held_out(), PER_CLASS, MAX_CHARS, SEED)
    return fit(rows, counts)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, common.table(spark, sf_dir, "labels"))
    scored = score(documents, model, keep_text=False)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
