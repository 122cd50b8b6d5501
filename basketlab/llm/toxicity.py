"""Toxicity by subword-bag embeddings under a linear softmax (operator 1).

A word is the bag of its hashed character n-grams and itself, a window of `WINDOW`
words the average of its words, and a two-class softmax reads the average. Embeddings
and softmax are trained jointly in numpy, so a misspelling never seen in training
shares the n-gram vectors of the words it resembles. A text's score is that of its
most toxic window; the windows that begin at every word of the whole text are scored, so
what stands before an insult doesn't cut it in two.

Training tiles a text by windows, by another offset each step. First each window gets its
text's label; then of a toxic text only the strongest window counts, of a clean text all.
Since the softmax is linear, a step over all windows is a few grouped sums,
and a trained model scores a window from one number per n-gram.

Scale: training rows are drawn by hashed id, at most `PER_CLASS` of each label and
none over `MAX_CHARS` characters, and one task fits the model on them, so its share is
bounded and the driver holds the model alone; class weights restore the labels' true
shares. Scoring is one pass without a shuffle. Per task a
cache of word values holds at most `CACHE` words and is then begun anew.

Defined cases: a null or empty text has no window and gets the softmax bias alone; a
text of one class only in training gives that class's share; without training rows
every score is 0. Extra columns are ignored; repeated rows are scored alike. Labels,
lang, source and ids are never inputs of a score.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.llm import common

BUCKETS = 1 << 18
DIM = 8
WINDOW = 4
GRAMS = (3, 4)
STEPS = 80
WARM = 30
RATE = 0.1
PER_CLASS = 2500
MAX_CHARS = 100_000
CACHE = 400_000
THRESHOLD = 0.5
SEED = 11
_MEAN = np.full(WINDOW, 1 / WINDOW)
_EDGES = ".,;:!?\"'()[]{}<>|*-_"


@dataclass(frozen=True)
class Model:
    """logit[b]: what n-gram b adds; bias: the softmax's own."""

    logit: np.ndarray
    bias: float


def subwords(token: str) -> list[int]:
    word = "<" + (token.lower().strip(_EDGES) or token) + ">"
    data = [word] + [word[i : i + n] for n in GRAMS for i in range(len(word) - n + 1) if n < len(word)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for x in data]


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[tuple[str, int]], counts: dict[int, int]) -> Model:
    """rows: (text, label 0 or 1); counts: labelled rows of each class in the tables."""
    labels = np.array([y for _, y in rows], dtype=np.float64)
    if len(rows) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(rows) else 0.0
        return Model(np.zeros(BUCKETS), 40.0 if share else -40.0)
    weight = np.where(labels == 1, counts[1] / max(1, labels.sum()), counts[0] / max(1, (1 - labels).sum()))
    weight = weight / weight.sum()

    vocabulary: dict[str, int] = {}
    ids = []
    for text, _ in rows:
        ids.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in text.split()], dtype=np.int32))
    sizes = np.array([len(x) for x in ids])
    ids = np.concatenate(ids)
    total = len(ids)
    if not total:
        return Model(np.zeros(BUCKETS), float(np.log(counts[1] / counts[0])))
    of_text = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    place = (np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    grams, bag_len = array("i"), np.empty(len(vocabulary), dtype=np.int64)
    for i, word in enumerate(vocabulary):  # no list per word: they would take most of the memory
        bag = subwords(word)
        grams.extend(bag)
        bag_len[i] = len(bag)
    del vocabulary
    grams = np.frombuffer(grams, dtype=np.int32)
    bag_at = np.concatenate([[0], np.cumsum(bag_len)[:-1]])
    of_word = np.repeat(np.arange(len(bag_len), dtype=np.int32), bag_len)

    rng = np.random.default_rng(SEED)
    E = np.zeros((BUCKETS, DIM), dtype=np.float32)  # an n-gram never trained says nothing
    U = rng.normal(0, 0.1, (DIM, 2))
    bias = np.zeros(2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (E, U, bias)]
    for step in range(1, STEPS + 1):
        u = U[:, 1] - U[:, 0]
        gram = E @ u
        # windows of this step: their first words, texts and lengths
        starts = np.flatnonzero((place % WINDOW == step % WINDOW) | (place == 0))
        texts, lengths = of_text[starts], np.diff(np.append(starts, total))
        window = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
        first = np.flatnonzero(np.append(True, texts[1:] != texts[:-1]))
        shown = texts[first]  # texts that have a window
        per_text = np.diff(np.append(first, len(texts)))
        word = np.add.reduceat(gram[grams], bag_at) / bag_len
        z = np.add.reduceat(word[ids], starts) / lengths + (bias[1] - bias[0])
        if step <= WARM:
            g = np.repeat(weight[shown] / per_text, per_text) * (_sigmoid(z) - labels[texts])
        else:
            top = np.maximum.reduceat(z, first)
            best = np.flatnonzero(z == np.repeat(top, per_text))
            best = best[np.append(True, texts[best][1:] != texts[best][:-1])]
            g = weight[texts] * _sigmoid(z) * (labels[texts] == 0)
            toxic = labels[shown] == 1
            g[best[toxic]] = weight[shown[toxic]] * (_sigmoid(top[toxic]) - 1)
        by_word = np.bincount(ids, weights=(g / lengths)[window], minlength=len(bag_len)) / bag_len
        h = np.bincount(grams, weights=by_word[of_word], minlength=BUCKETS)
        dU = (E.T @ h)[:, None] * np.array([-1.0, 1.0])
        grads = (h[:, None] * u, dU, g.sum() * np.array([-1.0, 1.0]))
        for p, d, (m, v) in zip((E, U, bias), grads, state):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    u = U[:, 1] - U[:, 0]
    return Model((E @ u).astype(np.float64), float(bias[1] - bias[0]))


class _Words(dict):
    """Value of each word, computed when first met."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        value = self[token] = float(self.model.logit[subwords(token)].mean())
        return value


def score_text(text: str, values: _Words) -> float:
    words = text.split()
    if not words:
        return float(_sigmoid(values.model.bias))
    v = np.fromiter(map(values.__getitem__, words), dtype=np.float64, count=len(words))
    # windows begin at every word; a shorter text is one window
    means = np.convolve(v, _MEAN, "valid") if len(v) >= WINDOW else v.mean(keepdims=True)
    return float(_sigmoid(means.max() + values.model.bias))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep_text: bool = True) -> DataFrame:
    """`df` with the score of its text column."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        values = _Words(shared.value)
        return lambda texts: ([score_text(t, values) for t in texts],)

    return common.append(df, text, T.StructType([T.StructField(out, T.DoubleType())]), make, keep_text)


def held_out():
    """Rows whose labels are never learned."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame) -> Model:
    rows, counts = common.labelled_rows(documents, labels, "toxic", ~held_out(), PER_CLASS, MAX_CHARS, SEED)
    common.ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = sorted((r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)))), key=lambda r: (r[0], r[2]))
        model = fit([(t, y) for _, y, t in drawn], counts)
        yield pa.RecordBatch.from_pydict({"logit": [model.logit.tobytes()], "bias": [model.bias]})

    found = rows.repartition(1).mapInArrow(run, "logit binary, bias double").collect()
    if not found:  # without rows there may be no task
        return fit([], counts)
    return Model(np.frombuffer(found[0].logit), found[0].bias)


def keep_clean(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`df` without the rows whose score reaches `THRESHOLD`."""
    mark = common.free_name(df, "toxic")
    return score(df, model, text, mark).where(F.col(mark) < THRESHOLD).drop(mark)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
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
