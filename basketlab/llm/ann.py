"""Approximate nearest neighbours by learned partitions (operator 8).

Of a bounded sample a graph of nearest neighbours is built and cut into parts of equal
size with few edges between them. A small classifier (one hidden layer, softmax) is
trained to tell a vector's part, or rather the parts of its neighbours, from the vector
alone. Every vector of the table is put into its most probable part; a query asks its
several most probable parts and reranks all vectors there by exact inner product.

How many parts a query asks is measured: queries of the sample that the classifier was
not trained on are searched by brute force in the rest, and the smallest number with
recall `AIM` or more is taken. A query that would meet fewer than k others asks further parts.

Parts grow in number with the table, not in size: one that holds over `SPLIT` times
`PER_PART` vectors is cut again in the same way, by a classifier of its own, trained in a
task on a sample of the part, and so on. A query asks several parts of each part it
asks; the levels share the aimed recall.

Scale: only the first sample is on the driver, and sizes of the first parts; all others
stay in tables. Equal vectors are searched once and carry
their smallest k + 1 ids, enough for any ranking. Parts and their queries are cut into
blocks, so a hot part is many tasks, each of which returns at most k + 1 rows per
query, and none that the sample shows to be too far.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components
or have another length than the commonest one take no part, neither as queries nor as
candidates, nor do null ids; a repeated id is a candidate for its other rows only if
its id differs; fewer candidates than k are all returned; an empty table gives no rows.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlab.llm import common
from basketlab.llm.vectors import matrix, sample, usable
from basketlab.sources.scratch import materialize

K = 20
SAMPLE = 6000
TEST = 1000  # of the sample: queries of the measurement
PER_PART = 1500  # vectors a part is meant to have
SPLIT = 4  # a part of more times PER_PART is cut again
PARTS = 64  # of one cut, at most
FEW = 4  # and at least, if each then has LEAST vectors
LEAST = 40
GRAPH = 10
HIDDEN = 64
EPOCHS = 40
AIM = 0.96
BLOCK = 4096
SEED = 41


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Per row its k others with the largest inner product."""
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between them: halved along main
    directions, then improved by moving vertices to where most neighbours are."""
    of = np.zeros(len(x), dtype=np.int64)
    groups, made = [(np.arange(len(x)), parts)], 0
    while groups:
        rows, n = groups.pop()
        if n == 1:
            of[rows], made = made, made + 1
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        main = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order, cut = rows[np.argsort(centred @ main, kind="stable")], len(rows) * (n // 2) // n
        groups += [(order[:cut], n // 2), (order[cut:], n - n // 2)]
    room = int(np.ceil(1.05 * len(x) / parts))
    back = [[] for _ in range(len(x))]  # undirected
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    near = [np.concatenate([row, np.array(b, dtype=np.int64)]) for row, b in zip(graph, back)]
    sizes = np.bincount(of, minlength=parts)
    rng = np.random.default_rng(SEED)
    for _ in range(6):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(of[near[i]], minlength=parts)
            best = int(np.where(sizes < room, votes, -1).argmax())
            if votes[best] > votes[of[i]]:
                sizes[of[i]] -= 1
                sizes[best] += 1
                of[i], moved = best, moved + 1
        if moved < len(x) // 200:
            break
    return of


class Router:
    """Probabilities of the parts for vectors, by one hidden layer."""

    def __init__(self, dim: int, parts: int, rng):
        self.p = [rng.normal(0, 1 / np.sqrt(dim), (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
        self.scale = 1.0

    def _forward(self, x):
        h = np.maximum(0, x @ self.p[0] + self.p[1])
        z = h @ self.p[2] + self.p[3]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return h, e / e.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x / self.scale)[1]

    def train(self, x: np.ndarray, target: np.ndarray, rng) -> None:
        """Adam on cross entropy with soft targets."""
        self.scale = float(np.sqrt((x * x).sum(axis=1).mean() / x.shape[1])) or 1.0
        x, step = x / self.scale, 0
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in self.p]
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows, step = order[at : at + 256], step + 1
                h, prob = self._forward(x[rows])
                dz = (prob - target[rows]) / len(rows)
                dh = (dz @ self.p[2].T) * (h > 0)
                grads = (x[rows].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))
                for p, g, (m, v) in zip(self.p, grads, state):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def learn(found: np.ndarray, parts: int, k: int = K, aim: float = AIM) -> tuple[Router, int]:
    """The router and how many parts a query asks."""
    rng = np.random.default_rng(SEED)
    if parts == 1 or len(found) < 4 * GRAPH:
        return Router(found.shape[1], 1, rng), 1
    test = min(TEST, len(found) // 5)
    held, x = found[:test], found[test:]
    graph = neighbour_graph(x, GRAPH)
    of = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), GRAPH), of[graph].ravel()), 0.5 / GRAPH)
    target[np.arange(len(x)), of] += 0.5
    router = Router(found.shape[1], parts, rng)
    router.train(x, target, rng)
    home = router.probabilities(x).argmax(axis=1)
    scores = held @ x.T
    best = np.argpartition(-scores, min(k, len(x) - 1) - 1, axis=1)[:, :k]
    order = np.argsort(-router.probabilities(held), axis=1, kind="stable")
    place = np.empty_like(order)
    place[np.arange(len(held))[:, None], order] = np.arange(parts)[None, :]
    needed = place[np.arange(len(held))[:, None], home[best]]  # at which place each neighbour's part is asked
    recall = [(needed < t).mean() for t in range(1, parts + 1)]
    return router, int(np.argmax(np.array(recall) >= aim)) + 1 if max(recall) >= aim else parts


def parts_of(total: int, per_part: int) -> int:
    """How many parts a table or a part of so many vectors is cut into."""
    return int(min(PARTS, max(total // per_part, min(FEW, total // LEAST), 1)))


def levels_of(total: int, per_part: int) -> int:
    """How often parts are cut until they are small."""
    levels, size = 1, total / parts_of(total, per_part)
    while size > SPLIT * per_part:
        levels, size = levels + 1, size / PARTS
    return levels


def index(classes: DataFrame, router: Router) -> DataFrame:
    """c, least, vec, part of every different vector; parts are numbered from 1."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                part = router.probabilities(matrix(batch.column(2))).argmax(axis=1) + 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int64())], names=["c", "least", "vec", "part"])

    return classes.select("c", "least", F.col("vec").cast("array<double>")).mapInArrow(run, "c long, least long, vec array<double>, part long")


def asks(router: Router, probes: int, sizes: np.ndarray, last: np.ndarray, known: np.ndarray, x: np.ndarray, k: int):
    """(rows, parts, bounds): each row of x once per part it asks. A bound is the score
    of the (k + 1)-th best of `known` (some of the vectors) in those parts, so that
    whatever scores less can't be in the result; a query with fewer of them has none.
    Only parts that are cut no further (`last`) count for it."""
    order = np.argsort(-router.probabilities(x), axis=1, kind="stable")
    met = np.cumsum(sizes[order], axis=1)
    enough = (met < k + 1).sum(axis=1) + 1  # parts until k others are met
    count = np.minimum(np.maximum(enough, probes), order.shape[1])
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    asked, bound = place < count[:, None], np.full(len(x), -np.inf)
    home = router.probabilities(known).argmax(axis=1)
    known, home = known[last[home]], home[last[home]]
    for at in range(0, len(x) if len(known) > k else 0, 256):
        s = np.where(asked[at : at + 256][:, home], x[at : at + 256] @ known.T, -np.inf)
        best = np.partition(s, len(known) - k - 1, axis=1)[:, len(known) - k - 1]
        bound[at : at + 256] = best - 1e-9 * (1 + np.abs(best))
    rows = np.repeat(np.arange(len(order)), count)
    parts = np.concatenate([o[:n] for o, n in zip(order, count)])
    return rows, parts, bound[rows]


def route(asked: DataFrame, router: Router, probes: int, sizes: np.ndarray, last: np.ndarray, k: int, known: np.ndarray) -> DataFrame:
    """c, vec, part, bound: each query once per part it asks."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, parts, bound = asks(router, probes, sizes, last, known, matrix(batch.column(1)), k)
            took = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), pa.array(parts + 1, pa.int64()), pa.array(bound)], names=["c", "vec", "part", "bound"])

    return asked.select("c", F.col("vec").cast("array<double>")).mapInArrow(run, "c long, vec array<double>, part long, bound double")


# --- parts that are cut again: the children of part p are p * PARTS + 1, 2, ... --------

def _packed(router: Router, probes: int, known: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *router.p, scale=router.scale, probes=probes, known=known)
    return out.getvalue()


def _unpacked(data: bytes) -> tuple[Router, int, np.ndarray]:
    kept = np.load(io.BytesIO(data))
    router = Router.__new__(Router)
    router.p, router.scale = [kept[f"arr_{i}"] for i in range(4)], float(kept["scale"])
    return router, int(kept["probes"]), kept["known"]


def _fit(per_part: int, k: int, aim: float):
    def run(rows: pa.Table) -> pa.Table:
        x, n = matrix(rows.column("vec")), rows.column("n")[0].as_py()
        router, probes = learn(x, parts_of(n, per_part), k, aim)
        return pa.table({"part": rows.column("part").slice(0, 1), "router": pa.array([_packed(router, probes, x)], pa.binary())})

    return run


def _descend(rows: pa.Table, routers: pa.Table) -> pa.Table:
    router, _, _ = _unpacked(routers.column("router")[0].as_py()) if rows.num_rows else (None, 0, None)
    child = router.probabilities(matrix(rows.column("vec"))).argmax(axis=1) if rows.num_rows else np.zeros(0, np.int64)
    part = rows.column("part").to_numpy().astype(np.int64) * PARTS + 1 + child
    return pa.table({"c": rows.column("c"), "least": rows.column("least"), "vec": rows.column("vec"), "part": pa.array(part, pa.int64())})


def _ask_again(limit: int, k: int):
    def run(rows: pa.Table, routers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"c": rows.column("c"), "vec": rows.column("vec"), "part": rows.column("part"), "bound": pa.array([], pa.float64())})
        router, probes, known = _unpacked(routers.column("router")[0].as_py())
        sizes, part = np.zeros(len(router.p[3]), dtype=np.int64), rows.column("part")[0].as_py()
        for child in routers.column("children")[0].as_py():
            sizes[child["part"] - part * PARTS - 1] = child["n"]
        at, parts, bound = asks(router, probes, sizes, sizes <= limit, known, matrix(rows.column("vec")), k)
        took = rows.take(pa.array(at))
        return pa.table({"c": took.column("c"), "vec": took.column("vec"), "part": pa.array(part * PARTS + 1 + parts, pa.int64()), "bound": pa.array(bound)})

    return run


def _by_block(rows: DataFrame, routers: DataFrame, run, schema: str) -> DataFrame:
    """`run` on blocks of a part's rows, each with the part's row of `routers`."""
    blocks = rows.groupBy("part").agg(F.ceil(F.count("*") / (4 * BLOCK)).cast("long").alias("blocks"))
    blocks = materialize(blocks.join(routers.select("part"), "part"), "blocks")
    dealt = rows.join(blocks, "part").withColumn("b", F.pmod(F.xxhash64("c"), F.col("blocks"))).drop("blocks")
    copies = routers.join(blocks, "part").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    return dealt.groupBy("part", "b").cogroup(copies.groupBy("part", "b")).applyInArrow(run, schema)


def deepen(placed: DataFrame, asked: DataFrame, per_part: int, k: int, aim: float, final: bool) -> tuple[DataFrame, DataFrame, bool]:
    """`placed` and `asked` after one more cut of all parts that are too large, and
    whether there were any."""
    limit = SPLIT * per_part
    large = materialize(placed.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > limit), "large")
    if large.isEmpty():
        return placed, asked, False
    space = 1 << 32
    drawn = placed.join(large, "part").where(F.pmod(F.xxhash64("vec", F.lit(SEED + 1)), F.lit(space)) * F.col("n") < F.lit(SAMPLE * space))
    routers = materialize(drawn.select("part", "n", "vec").groupBy("part").applyInArrow(_fit(per_part, k, aim), "part long, router binary"), "routers")
    moved = _by_block(placed.join(routers.select("part"), "part", "left_semi"), routers, _descend, "c long, least long, vec array<double>, part long")
    moved = materialize(moved, "moved")
    parent = F.floor((F.col("part") - 1) / PARTS).cast("long")
    sizes = moved.groupBy("part").agg(F.count("*").alias("n"))
    children = sizes.groupBy(parent.alias("part")).agg(F.collect_list(F.struct(F.col("part"), F.col("n"))).alias("children"))
    again = _by_block(asked.join(routers.select("part"), "part", "left_semi").drop("bound"), routers.join(children, "part"), _ask_again((1 << 62) if final else limit, k), "c long, vec array<double>, part long, bound double")
    rest = routers.select("part")
    placed = materialize(placed.join(rest, "part", "left_anti").unionByName(moved), "index")
    return placed, materialize(asked.join(rest, "part", "left_anti").unionByName(again), "asked"), True


def _rerank(k: int):
    def run(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        c, least, x = rows.column("c").to_numpy(), rows.column("least").to_numpy(zero_copy_only=False), matrix(rows.column("vec"))
        bound = rows.column("bound").to_numpy(zero_copy_only=False)[asks]
        q, y, qc, yc, first = x[asks], x[~asks], c[asks], c[~asks], least[~asks].astype(np.int64)
        out = [[], [], []]
        n = min(k, len(y))
        for i in range(len(q) if n else 0):
            s = (y * q[i]).sum(axis=1)
            at = np.flatnonzero(s >= max(bound[i], np.partition(s, len(s) - n)[len(s) - n]))
            at = at[np.lexsort((first[at], -s[at]))][:n]
            out[0].append(np.full(len(at), qc[i]))
            out[1].append(yc[at])
            out[2].append(s[at])
        q, y, s = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.table({"q": pa.array(q.astype(np.int64)), "c": pa.array(y.astype(np.int64)), "score": pa.array(s.astype(np.float64))})

    return run


def search(df: DataFrame, key: str, vector: str, queries, k: int = K, per_part: int = PER_PART) -> DataFrame:
    """query_id, rank, id, score: for each row with the condition `queries` (on id) its
    k nearest other ids found, by inner product of the original vectors in doubles."""
    rows = materialize(usable(df, key, vector).where("ok and id is not null").select("id", "vec"), "embedded")
    same = Window.partitionBy("vec").orderBy("id")
    ids = rows.distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    classes = ids.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = materialize(classes.withColumn("least", F.col("ids")[0]).withColumn("c", F.monotonically_increasing_id()), "vectors")
    total = classes.count()
    if not total:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)
    levels = levels_of(total, per_part)
    aim = AIM ** (1 / levels)
    known = sample(classes, SAMPLE, SEED)
    router, probes = learn(known, parts_of(total, per_part), k, aim)
    placed = materialize(index(classes, router), "index")
    found = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # PARTS rows at most
    sizes = np.array([found.get(p + 1, 0) for p in range(len(router.p[3]))])
    last = sizes <= SPLIT * per_part if levels > 1 else np.ones(len(sizes), dtype=bool)
    query_rows = materialize(rows.where(queries).join(classes.select("vec", "c"), "vec").select("id", "c", "vec"), "queries")
    asked = route(query_rows.groupBy("c").agg(F.any_value("vec").alias("vec")), router, probes, sizes, last, k, known)
    asked = materialize(asked, "asked")
    for level in range(2, levels + 1):
        placed, asked, more = deepen(placed, asked, per_part, k, aim, level == levels)
        if not more:
            break
    counts = placed.groupBy("part").agg(F.count("*").alias("n")).join(asked.groupBy("part").agg(F.count("*").alias("q")), "part")
    block = lambda c: F.ceil(F.col(c) / BLOCK).cast("long").alias(f"{c}_blocks")
    counts = materialize(counts.select("part", block("n"), block("q")), "sizes")  # a row a part
    deal = lambda c: F.pmod(F.xxhash64("c"), F.col(c)).cast("long")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = placed.join(counts, "part").select("part", deal("n_blocks").alias("yb"), every("q_blocks").alias("qb"), F.lit(False).alias("asks"), "c", "least", "vec", F.lit(None).cast("double").alias("bound"))
    right = asked.join(counts, "part").select("part", every("n_blocks").alias("yb"), deal("q_blocks").alias("qb"), F.lit(True).alias("asks"), "c", F.lit(None).cast("long").alias("least"), "vec", "bound")
    near = left.unionByName(right).groupBy("part", "yb", "qb").applyInArrow(_rerank(k + 1), "q long, c long, score double")
    near = near.join(classes.select("c", "least", "ids"), "c")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "least"))).where(F.col("n") <= k + 1)
    near = materialize(near.select("q", "ids", "score"), "near")
    pairs = query_rows.select(F.col("id").alias("query_id"), F.col("c").alias("q")).join(near, "q")
    pairs = pairs.select("query_id", F.explode("ids").alias("id"), "score").where("id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose vec_id is divisible by 20."""
    found = search(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
