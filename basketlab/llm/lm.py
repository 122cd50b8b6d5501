"""Scoring texts by a causal self-attention model trained in numpy (operator 12).

A text is its words (runs without ASCII white space, A-Z in lower case) and an end
token. Words become subword ids, a blank before each, by the first `SUBWORDS` - 1 ranks
of a public byte-level vocabulary. Of the next id the attention model gives

    P(id | before) = softmax(D[last] + attention(before) U)[class] * P(id | last, class)

where D and the last factor come from counts of neighbouring ids over the words of all
training documents (smoothed, so everything has a chance), classes are groups of ids with
like neighbours, and attention (one head over at most `WINDOW` ids) and U are trained on
all of them. The probabilities of all ids add up to 1. A word's chance is the product
over its ids, mixed with the word's share of all training tokens: the corpus knows common
words better than their spelling does.

    P(word | before) = (1 - MIXED) * product + MIXED * count / all

Windows overlap: each scores its last `STEP` ids, with at least `LEAD` ids before each
where the text has them, so every id is scored once. A batch of windows is one masked
batched attention; what depends on an id or a place alone is multiplied out beforehand,
in training once a step. Arrays of a step are used again by the next, words that a worker
has spelled by its next task.

Scale: one pass counts words, combined per task; neighbours are counted on the table of
distinct words (between words: by the shares of last and first ids). Every training
document is trained on once, whole, in one of `ROUNDS` rounds; a round's trainers, one for
about `TRAINER` windows, train copies of the model side by side, which are averaged on
Spark. The driver holds one model, counts of
neighbouring ids (at most `SUBWORDS` squared) and the counts of at most `COMMON` words,
which are broadcast; all other words get their counts by a join, so no list of all words
is held anywhere, and no word of the join is common enough to be a hot key.

Defined cases: null or empty texts are the end token alone; repeated rows each count;
rows with a null id are scored but not learned from and aren't held out; without
training documents the model is the untrained one and the base is 0. Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import itertools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm import common
from basketlab.llm.tokens import Grown, vocabulary
from basketlab.sources.scratch import materialize

VOCABULARY = "byte_bpe_50k.tiktoken"
SUBWORDS = 2048
END = SUBWORDS - 1
PAD = SUBWORDS
CLASSES = 64
DIM = 24
WINDOW = 24
STEP = 16  # ids that a window scores, its last ones
LEAD = WINDOW - STEP  # ids before them
TRAINER = 30_000
ROUNDS = 2
BATCH = 128
RATE = 0.01
SEED = 7
MIXED = 0.25  # weight of a word's share of the training tokens
SMOOTH = 8.0  # how many neighbours the smoothing counts as
COMMON = 1 << 18
CACHE = 500_000
CHUNK = 512  # windows scored at once
_NONE: list = []


class Words(defaultdict):
    """Number of each word met, and its subword ids; begun anew by `forget`."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = {k: v for k, v in ranks.items() if v < END}
        # words are parted at blanks, and into parts of at most 32 characters, so that a
        # very long word costs no more than its length
        coding = tiktoken.Encoding("subwords", pat_str=r" [^ ]{1,31}|[^ ]{1,32}", mergeable_ranks=ranks, special_tokens={})
        self.encode = partial(coding.encode_to_numpy, disallowed_special=())
        self.begins = np.zeros(SUBWORDS, dtype=bool)  # ids that begin a word
        self.begins[[v for k, v in ranks.items() if k[:1] == b" "]] = True
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.default_factory = itertools.count().__next__
        self.names: list[bytes] = []
        # ids of all words one after another; where each word's begin, and how many it has
        self.ids, self.starts, self.sizes = Grown(np.uint16), Grown(np.int64), Grown(np.int64)

    def _spell(self) -> None:
        """Ids of the words met since it was last called."""
        new = list(islice(reversed(self), len(self) - len(self.names)))[::-1]
        if not new:
            return
        flat = self.encode(" " + b" ".join(new).decode()).astype(np.uint16)
        starts = np.flatnonzero(self.begins[flat])
        self.starts.extend(self.ids.n + starts)
        self.sizes.extend(np.diff(np.append(starts, len(flat))))
        self.ids.extend(flat)
        self.names += new

    def numbers(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of some texts, and how many each text has."""
        split = [words_of(t) for t in texts]
        found = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), dtype=np.int64)
        self._spell()
        return found, np.array([len(ws) for ws in split], dtype=np.int64)

    def subwords(self, numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts' words, an end after each text, and how many each text has."""
        size = np.insert(self.sizes.all()[numbers], np.cumsum(lengths), 1)
        # an end is read from a place after the known ids
        start = np.insert(self.starts.all()[numbers], np.cumsum(lengths), self.ids.n)
        after = np.cumsum(size)
        at = np.arange(after[-1] if len(after) else 0) + np.repeat(start - (after - size), size)
        ids = np.append(self.ids.all(), np.uint16(END))[at]
        return ids, np.add.reduceat(size, np.cumsum(lengths + 1) - (lengths + 1))


@cache
def kept_words(path: str) -> Words:
    """The words that a worker has met, kept from task to task."""
    return Words(path)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else _NONE


@dataclass
class Counted:
    """Bigrams and what follows from them: log chances of a class and, within it, of an id."""

    group: np.ndarray  # class of each id
    by_class: np.ndarray  # D[last, class]
    within: np.ndarray | None  # log P(id | last, class) at [last, id]
    ids: float = 0.0  # how many ids were counted


def _classes(pairs: np.ndarray) -> np.ndarray:
    """Groups of ids whose neighbours are alike, by a few rounds of k-means."""
    like = np.concatenate([pairs, pairs.T], axis=1).astype(np.float32)
    like = np.sqrt(like / np.maximum(like.sum(axis=1, keepdims=True), 1))
    often = np.argsort(-pairs.sum(axis=0), kind="stable")
    centres = like[often[:CLASSES]]
    for _ in range(8):
        group = np.argmax(like @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, group, like)
        size = np.bincount(group, minlength=CLASSES)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return group


def counted(pairs: np.ndarray) -> Counted:
    """pairs[a, b]: how often id b follows id a in the training documents."""
    pairs = pairs.astype(np.float64)
    group = _classes(pairs)
    member = np.eye(CLASSES)[group]
    once = pairs.sum(axis=0) + 1.0  # ids never seen have a chance too
    of_class = once @ member
    used = of_class > 0
    chance = once / of_class[group]  # P(id | class)
    totals = pairs @ member
    share = of_class / of_class.sum()
    with np.errstate(divide="ignore"):
        by_class = np.log((totals + SMOOTH * share) / (totals.sum(axis=1, keepdims=True) + SMOOTH))
        within = np.log((pairs + SMOOTH * chance) / (totals[:, group] + SMOOTH))
    by_class[:, ~used] = -1e4  # classes without ids
    return Counted(group, by_class.astype(np.float32), within.astype(np.float32), float(pairs.sum()))


# what is trained: embeddings of ids (and padding) and places, queries, keys, values, output
SHAPES = [(SUBWORDS + 1, DIM), (WINDOW, DIM), (DIM, DIM), (DIM, DIM), (DIM, DIM), (DIM, CLASSES)]
_SIZES = [math.prod(s) for s in SHAPES]
#: which places of a window each scored place sees
_SEEN = np.arange(WINDOW)[None, :] <= LEAD + np.arange(STEP)[:, None]
_LIMIT = 40.0  # of logits, so that no exponential overflows


def parts(weights: np.ndarray) -> list[np.ndarray]:
    cuts = itertools.accumulate(_SIZES)
    return [weights[end - n : end].reshape(s) for end, n, s in zip(cuts, _SIZES, SHAPES)]


def fresh() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    spread = np.repeat([0.5, 0.3, 0.25, 0.25, 0.25, 0.05], _SIZES)
    return (rng.normal(size=len(spread)) * spread).astype(np.float32)


class Room(dict):
    """Arrays by name that are written anew at every step, as fresh memory is slow."""

    def __call__(self, name: str, kind: np.dtype, *shape: int) -> np.ndarray:
        found = self.get(name)
        if found is None or found.shape != shape or found.dtype != kind:
            found = self[name] = np.empty(shape, dtype=kind)
        return found


def loss(weights: np.ndarray, c: Counted, ids: np.ndarray, targets: np.ndarray, room: Room | None = None) -> tuple[float, np.ndarray]:
    """Mean negative log chance of the targets' classes over windows, and its gradient.
    ids: (windows, WINDOW); targets: (windows, STEP), `PAD` where there is none."""
    E, P, Wq, Wk, Wv, U = parts(weights)
    kind, scale, n = weights.dtype, weights.dtype.type(DIM**-0.5), len(ids)
    room = Room() if room is None else room

    def make(name: str, *shape: int) -> np.ndarray:
        return room(name, kind, *shape)

    one = np.ones(max(CLASSES, WINDOW), dtype=kind)  # products with it sum rows
    # what follows of x = E + P: q k' = x (Wq Wk') x' and o U = (attention x) (Wv U), so that x
    # stands for keys and values
    A, B = Wq @ Wk.T * scale, Wv @ U
    # rows that are seen, then those that ask; a batch has few different ids, each is multiplied once
    asking, seen = SUBWORDS + 1, slice(0, WINDOW)
    asks, gives = slice(WINDOW, WINDOW + STEP), slice(WINDOW + STEP, None)
    rows = np.concatenate([ids, ids[:, LEAD:] + asking], axis=1).astype(np.uint16)
    order = np.argsort(rows.ravel(), kind="stable")
    begins = rows.ravel()[order]
    begins = np.flatnonzero(np.append(True, begins[1:] != begins[:-1]))
    met = rows.ravel()[order[begins]].astype(np.int64)
    cut = np.searchsorted(met, asking)
    met_seen, met_asks = met[:cut], met[cut:] - asking
    table = make("table", 2 * asking, DIM)
    table[met_seen], table[asking + met_asks] = E[met_seen], E[met_asks] @ A
    held = np.take(table, rows, axis=0, out=make("held", n, WINDOW + STEP, DIM), mode="clip")
    both = make("both", n, WINDOW + 2 * STEP, DIM)  # x, what asks, and what outputs give back
    np.add(held, np.concatenate([P, P[LEAD:] @ A]), out=both[:, : WINDOW + STEP])
    x, q = both[:, seen], both[:, asks]
    maps = make("maps", n, 2 * STEP, WINDOW)  # gradients of the logits, and the attention
    ds, a = maps[:, :STEP], maps[:, STEP:]
    np.matmul(q, x.transpose(0, 2, 1), out=a)
    np.clip(a, -_LIMIT, _LIMIT, out=a)
    np.exp(a, out=a)
    a *= _SEEN.astype(kind)
    # of places that score something, only those of a text's first window see padding
    a[np.flatnonzero(ids[:, 0] == PAD), :, :LEAD] = 0
    whole = (a @ one[:WINDOW])[:, :, None]
    o = np.matmul(a, x, out=make("o", n, STEP, DIM))
    o /= whole
    z = np.matmul(o.reshape(-1, DIM), B, out=make("z", n * STEP, CLASSES))
    if np.abs(o).max() * np.abs(B).sum(axis=0).max() > _LIMIT:  # a bound
        np.clip(z, -_LIMIT, _LIMIT, out=z)
    z += np.take(c.by_class, ids[:, LEAD:].ravel(), axis=0, out=room("last", c.by_class.dtype, n * STEP, CLASSES), mode="clip")
    y = targets.ravel()
    real = y != PAD
    wanted = np.arange(len(y)) * CLASSES + c.group.take(y, mode="clip")
    count = max(1, int(real.sum()))
    chosen = z.ravel()[wanted]
    dz = np.exp(z, out=z)
    sums = dz @ one[:CLASSES]
    value = ((np.log(sums) - chosen) * real).sum() / count
    share = (real / count).astype(kind)
    dz *= (share / sums)[:, None]
    dz.reshape(-1)[wanted] -= share
    dB = o.reshape(-1, DIM).T @ dz
    do = np.matmul(dz, B.T, out=make("do", n * STEP, DIM)).reshape(o.shape)
    do = np.divide(do, whole, out=both[:, gives])  # as the attention isn't divided by its sums
    np.matmul(do, x.transpose(0, 2, 1), out=ds)
    ds -= (np.multiply(do, o, out=o) @ one[:DIM])[:, :, None]
    ds *= a
    d = make("d", n, WINDOW + STEP, DIM)
    np.matmul(maps.transpose(0, 2, 1), both[:, WINDOW:], out=d[:, seen])
    np.matmul(ds, x, out=d[:, asks])
    by_row = np.take(d.reshape(-1, DIM), order, axis=0, out=held.reshape(-1, DIM), mode="clip")
    by_row, by_place = np.add.reduceat(by_row, begins, axis=0), d.sum(axis=0)
    dE, dP = np.zeros_like(E), by_place[seen]
    dE[met_seen] = by_row[:cut]
    dE[met_asks] += by_row[cut:] @ A.T
    dP[LEAD:] += by_place[asks] @ A.T
    dA = E[met_asks].T @ by_row[cut:] + P[LEAD:].T @ by_place[asks]
    grads = [dE, dP, dA @ Wk * scale, dA.T @ Wq * scale, dB @ U.T, Wv.T @ dB]
    return float(value), np.concatenate([g.ravel() for g in grads])


def train_on(weights: np.ndarray, c: Counted, batches: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = RATE) -> np.ndarray:
    """Weights after one Adam step a batch."""
    weights = weights.copy()
    m, v, by, room = np.zeros_like(weights), np.zeros_like(weights), np.empty_like(weights), Room()
    for step, (ids, targets) in enumerate(batches, 1):
        _, g = loss(weights, c, ids, targets, room)
        m *= 0.9
        m += np.multiply(g, 0.1, out=by)
        v *= 0.99
        g *= g
        g *= 0.01
        v += g
        # m / (1 - 0.9**step) over sqrt(v / (1 - 0.99**step)) + 1e-8
        few = math.sqrt(1 - 0.99**step)
        np.sqrt(v, out=by)
        by += 1e-8 * few
        np.divide(m, by, out=by)
        by *= rate * few / (1 - 0.9**step)
        weights -= by
    return weights


def windows(every: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, targets) of every window; every: ids of texts, each with its end."""
    blocks = -(-lengths // STEP)
    room = blocks * STEP + LEAD
    starts = np.cumsum(room) - room
    ids = np.full(int(room.sum()), PAD, dtype=np.int32)
    targets = ids.copy()
    place = np.arange(len(every)) + np.repeat(starts + LEAD - (np.cumsum(lengths) - lengths), lengths)
    targets[place] = every
    first = starts + LEAD
    ids[first] = END
    inner = np.ones(len(every), dtype=bool)
    inner[np.cumsum(lengths) - 1] = False  # nothing follows the end
    ids[place[inner] + 1] = every[inner]
    at = np.repeat(starts, blocks) + STEP * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    return ids[at[:, None] + np.arange(WINDOW)], targets[at[:, None] + LEAD + np.arange(STEP)]


class Scorer:
    """A trained model with what depends on an id or a place alone multiplied out."""

    def __init__(self, weights: np.ndarray, c: Counted):
        E, P, Wq, Wk, Wv, U = parts(weights)
        scale = np.float32(DIM**-0.5)
        one = np.ones((len(E), 1), dtype=np.float32)  # a value that sums the attention
        A = Wq @ Wk.T * scale  # as in `loss`
        self.q, self.x = E @ A, np.concatenate([E, one], axis=1)
        self.place_q, self.place_x = P[LEAD:] @ A, np.pad(P, ((0, 0), (0, 1)))
        self.seen, self.room = _SEEN.astype(np.float32), Room()
        # an output is an average of values, so this bounds what it adds to a logit
        most = np.abs(E @ Wv @ U).max() + np.abs(P @ Wv @ U).max() + 1e-9
        self.B, self.c, self.ones = Wv @ U * np.float32(min(1, _LIMIT / most)), c, np.ones(CLASSES, dtype=np.float32)

    def window_logs(self, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log chance of each target (0 where there is none)."""
        n, last = len(ids), ids[:, LEAD:].ravel()

        def make(name: str, *shape: int) -> np.ndarray:
            return self.room(name, self.q.dtype, *shape)

        q = np.take(self.q, ids[:, LEAD:], axis=0, out=make("q", n, STEP, DIM), mode="clip")
        q += self.place_q
        x = np.take(self.x, ids, axis=0, out=make("x", n, WINDOW, DIM + 1), mode="clip")
        x += self.place_x
        s = np.matmul(q, x[:, :, :DIM].transpose(0, 2, 1), out=make("s", n, STEP, WINDOW))
        np.clip(s, -_LIMIT, _LIMIT, out=s)
        np.exp(s, out=s)
        s *= self.seen
        # of places that score something, only those of a text's first window see padding
        s[np.flatnonzero(ids[:, 0] == PAD), :, :LEAD] = 0
        o = np.matmul(s, x, out=make("o", n, STEP, DIM + 1)).reshape(-1, DIM + 1)
        z = np.matmul(o[:, :DIM] / o[:, DIM:], self.B, out=make("z", n * STEP, CLASSES))
        z += np.take(self.c.by_class, last, axis=0, out=make("last", n * STEP, CLASSES), mode="clip")
        y = targets.ravel()
        real = y != PAD
        chosen = z.ravel()[np.arange(len(y)) * CLASSES + self.c.group.take(y, mode="clip")]
        np.exp(z, out=z)
        # padding counts as the last id, whose chance isn't used
        chosen += self.c.within.ravel()[np.minimum(last, END).astype(np.int64) * SUBWORDS + np.minimum(y, END)]
        chosen -= np.log(z @ self.ones)
        return np.where(real, chosen, 0).reshape(targets.shape)

    def logs(self, every: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log chance of each id of texts, one after another."""
        ids, targets = windows(every, lengths)
        found = [np.zeros(0)]
        for at in range(0, len(ids), CHUNK):
            part = targets[at : at + CHUNK]
            found.append(self.window_logs(ids[at : at + CHUNK], part)[part != PAD])
        return np.concatenate(found)


def held_out():
    """Documents that are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.col("text").cast("binary").alias("text"))


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, common.SLICE_ROWS):
            part = batch.slice(at, common.SLICE_ROWS)
            yield part, part.column(column).to_pylist()


def count(learned: DataFrame) -> DataFrame:
    """word (empty for the end), n over all of `learned` (text as binary); a written table."""
    common.ship(learned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows():
            names, n = list(found), list(found.values())
            found.clear()
            for at in range(0, len(names), 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(names[part], pa.binary()), pa.array(n[part], pa.int64())], names=["word", "n"])

        for _, texts in _slices(batches, 1):
            found.update(chain.from_iterable(map(words_of, texts)))
            found[b""] += len(texts)
            if len(found) > CACHE:
                yield from rows()
        yield from rows()

    made = learned.select("doc_id", "text").mapInArrow(run, "word binary, n long")
    return materialize(made.groupBy("word").agg(F.sum("n").alias("n")), "counts")


def neighbours(counts: DataFrame, path: str) -> Counted:
    """From the words of `count`: how often ids follow each other."""
    common.ship(counts.sparkSession)
    cells = SUBWORDS * (SUBWORDS + 2)  # pairs, then first ids of words, then last ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Words(path), np.zeros(cells)
        for batch in batches:
            known.forget()
            known.numbers(batch.column(0).to_pylist())  # distinct words, so their numbers ascend
            n = batch.column(1).to_numpy().astype(np.float64)
            size, flat = known.sizes.all(), known.ids.all().astype(np.int64)
            last = np.cumsum(size) - 1
            inner = np.ones(len(flat), dtype=bool)
            inner[last] = False
            at = np.flatnonzero(inner)
            where = [flat[at] * SUBWORDS + flat[at + 1], SUBWORDS**2 + flat[last - size + 1], SUBWORDS**2 + SUBWORDS + flat[last]]
            weights = np.concatenate([np.repeat(n, size)[at], n, n])
            total += np.bincount(np.concatenate(where), weights=weights, minlength=cells)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64))], names=["cell", "n"])

    made = counts.where("word <> x''").select("word", "n").mapInArrow(run, "cell long, n long")
    found = made.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    texts = counts.where("word = x''").agg(F.sum("n")).first()[0] or 0
    total = np.zeros(cells)
    total[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    pairs, (first, last) = total[: SUBWORDS**2].reshape(SUBWORDS, SUBWORDS), total[SUBWORDS**2 :].reshape(2, SUBWORDS)
    words = max(1.0, first.sum())
    ends = min(1.0, texts / words)  # chance that a word is a text's last
    pairs += np.outer(last, first / words) * (1 - ends)
    pairs[:, END] += last * ends
    pairs[END] += texts * first / words
    return counted(pairs)


def mixed_batches(batches: Iterator[pa.RecordBatch], known: Words, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, targets) of all windows of all texts, `BATCH` at a time, each window once; the
    windows of texts that follow each other, at least `TRAINER` of them, are mixed."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def steps():
        ids, targets = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        held.clear()
        order = rng.permutation(len(ids))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            yield ids[part].astype(np.int64), targets[part].astype(np.int64)

    for _, texts in _slices(batches, 1):
        if len(known.names) > CACHE:
            known.forget()
        held.append(tuple(x.astype(np.uint16) for x in windows(*known.subwords(*known.numbers(texts)))))
        if sum(len(ids) for ids, _ in held) >= TRAINER:
            yield from steps()
    if held:
        yield from steps()


def _mean(rows) -> tuple[int, np.ndarray] | None:
    """(n, mean weights) of rows (n, weights as bytes), weighted by n."""
    total, n = None, 0
    for k, data in rows:
        values = np.frombuffer(data, dtype=np.float32).astype(np.float64) * k
        total, n = values if total is None else total + values, n + k
    return None if total is None else (n, (total / n).astype(np.float32))


def _averaged(rows: DataFrame) -> np.ndarray | None:
    """Mean of the trainers' weights (trainer, n, weights), weighted by n windows; means of
    64 at a time on Spark, until the driver gets 64 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = None

        def held():
            nonlocal least
            for batch in batches:
                for trainer, n, weights in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    least = trainer if least is None else least
                    yield n, weights

        if (mean := _mean(held())) is not None:
            yield pa.RecordBatch.from_pydict({"trainer": [least], "n": [mean[0]], "weights": [mean[1].tobytes()]})

    while (held := rows.count()) > 64:
        dealt = rows.repartition(-(-held // 64), "trainer").sortWithinPartitions("trainer")
        fewer = materialize(dealt.mapInArrow(run, "trainer long, n long, weights binary"), "means")
        if fewer.count() >= held:
            break
        rows = fewer
    mean = _mean((r["n"], r["weights"]) for r in rows.orderBy("trainer").collect())
    return None if mean is None else mean[1]


def fit(learned: DataFrame, c: Counted, path: str) -> np.ndarray:
    """Weights trained on all windows of `learned` (doc_id, text as binary), each once: the
    documents are dealt to `ROUNDS` rounds by hash; those of a round are trained on side by
    side on Spark, and the models averaged."""
    common.ship(learned.sparkSession)
    context = learned.sparkSession.sparkContext
    trainers = max(1, math.ceil(c.ids / STEP / TRAINER / ROUNDS))
    weights = fresh()
    mixed = F.xxhash64("doc_id", "text", F.lit(SEED))
    for round_ in range(ROUNDS):
        # training needs no chances within classes
        shared, rate = context.broadcast((weights, Counted(c.group, c.by_class, None))), RATE / (1 + 2 * round_)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, trainer = 0, TaskContext.get().partitionId()

            def steps():
                nonlocal seen
                for ids, targets in mixed_batches(batches, kept_words(path), np.random.default_rng([SEED, round_, trainer])):
                    seen += len(ids)
                    yield ids, targets

            trained = train_on(*shared.value, steps(), rate)
            if seen:
                yield pa.RecordBatch.from_pydict({"trainer": [trainer], "n": [seen], "weights": [trained.tobytes()]})

        dealt = learned.select("doc_id", "text", mixed.alias("mixed")).where(F.pmod("mixed", F.lit(ROUNDS)) == round_)
        dealt = dealt.repartition(trainers, "mixed").sortWithinPartitions("mixed")
        made = materialize(dealt.select("doc_id", "text").mapInArrow(run, "trainer long, n long, weights binary"), "trained")
        shared.destroy()
        mean = _averaged(made)
        weights = weights if mean is None else mean
    return weights


@dataclass
class Model:
    weights: np.ndarray
    counted: Counted
    common: dict[bytes, int]  # counts of the commonest words


def common_words(counts: DataFrame) -> dict[bytes, int]:
    """At most `COMMON` words and their counts: all words from some size of count on."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect(), reverse=True)
    held, least = 0, None
    for r in sizes:
        held += r["k"]
        if held > COMMON:
            break
        least = r["step"]
    if least is None:
        return {}
    found = counts.where(step >= least).select("word", "n").toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))


def learn(documents: DataFrame, path: str) -> tuple[Model, DataFrame]:
    """The model, and the written counts of all words (word, n)."""
    learned = _texts(documents.where(~held_out()))
    counts = count(learned)
    c = neighbours(counts, path)
    weights = fit(learned, c, path)
    return Model(weights, c, common_words(counts)), counts


def scored(documents: DataFrame, model: Model, counts: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, train_tokens of every row."""
    spark = documents.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V")).first()
    n_all, least = max(1, totals["N"]), math.log10(totals["N"] + totals["V"] + 1)
    kind = dict(documents.dtypes)["doc_id"]
    # `row` names a row of the table, as ids may repeat
    schema = f"doc_id {kind}, row long, n_tokens long, known long, logs double, score double, rare array<struct<word:binary,log:double>>"
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("log", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer, known, row = Scorer(model.weights, model.counted), kept_words(path), TaskContext.get().partitionId() << 33
        held = Grown(np.float64)  # counts of the known words, 0 for those that aren't common
        for part, texts in _slices(batches, 1):
            if len(known.names) > CACHE:
                known.forget()
                held = Grown(np.float64)
            numbers, lengths = known.numbers(texts)
            held.extend([float(model.common.get(w, 0)) for w in known.names[held.n :]])
            # every word and, after its last one, the end of each text
            ends = np.cumsum(lengths + 1) - 1
            word = np.ones(len(numbers) + len(texts), dtype=bool)
            word[ends] = False
            n = np.full(len(word), float(model.common.get(b"", 0)))
            n[word] = held.all()[numbers]
            size = np.ones(len(word), dtype=np.int64)
            size[word] = known.sizes.all()[numbers]
            of = np.repeat(np.arange(len(texts)), lengths + 1)
            logs = np.add.reduceat(scorer.logs(*known.subwords(numbers, lengths)), np.cumsum(size) - size)
            mixed = logs + math.log(1 - MIXED)
            met = n > 0
            mixed[met] = np.logaddexp(mixed[met], np.log(n[met] * (MIXED / n_all)))
            name = np.full(len(word), -1)
            name[word] = numbers
            at = np.flatnonzero(~met)
            begins = np.searchsorted(of[at], np.arange(len(texts) + 1))
            unknown = [known.names[i] if i >= 0 else b"" for i in name[at].tolist()]
            rare = pa.StructArray.from_arrays([pa.array(unknown, pa.binary()), pa.array(logs[at])], fields=list(rare_type.value_type))
            arrays = [
                part.column(0),
                pa.array(np.arange(row, row + len(texts))),
                pa.array(lengths + 1, pa.int64()),
                pa.array(np.bincount(of[met], minlength=len(texts)), pa.int64()),
                pa.array(np.bincount(of, weights=np.log10(n + 1), minlength=len(texts))),
                pa.array(np.bincount(of, weights=mixed, minlength=len(texts)) / math.log(10)),
                pa.ListArray.from_arrays(pa.array(begins, pa.int32()), rare),
            ]
            row += len(texts)
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "n_tokens", "known", "logs", "score", "rare"])

    made = materialize(_texts(documents).mapInArrow(run, schema), "scored")
    rest = made.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.log").join(counts, "word")
    # what the word's share adds to a chance without it
    more = F.log(F.col("n") * (MIXED / n_all / (1 - MIXED))) - F.col("log")
    more = F.when(more > 30, more).otherwise(F.log1p(F.exp(more))) / math.log(10)
    rest = rest.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"), F.count("*").alias("more"), F.sum(more).alias("more_score"))
    whole = made.drop("rare").join(rest, "row", "left")
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * least).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
        F.lit(totals["N"]).cast("long").alias("train_tokens"),
    )


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary(VOCABULARY)
    found = scored(documents, *learn(documents, path), path)
    out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return found.select("doc_id", out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
