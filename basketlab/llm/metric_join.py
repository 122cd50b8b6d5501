"""Near-duplicate vectors by an exact metric range join (operator 6).

Vectors scaled to length 1 link at cosine >= 0.9, that is, at angle <= R or chord
<= sqrt(0.2). Pivots partition them: each goes to the cell of its nearest pivot. A
linked pair of two cells p and q lies on both sides of the plane between the pivots,
so by the triangle inequality both ends are within one chord of that plane; only such
boundary vectors are copied to the pair (p, q), and each pair of cells is joined by
itself. Vectors within half of R of their pivot (the cell's ball) are linked to each
other without being compared.

Scale: equal vectors collapse first. Cells are cut into blocks of at most about `BLOCK`
vectors, so a hot cell is many small tasks. A block pair returns numbers of links per
vector and links that connect the same parts, not all pairs. Where vectors have no
structure every vector is near every plane and the join has to compare all blocks: the
number of comparisons then grows with the square of the different vectors, as it must
for any exact method on such data.

Pivots are chosen from at most `SAMPLE` vectors: dense spots first, then others. The
sample decides only speed: every vector is placed and every possible link compared.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components
or have another length than the commonest one link with nothing and are kept; repeated
rows link with each other; a null id has links but never names a component; an empty
table gives no rows. Other columns, label among them, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlab.llm import common
from basketlab.llm.blocks import star_links
from basketlab.llm.components import components
from basketlab.llm.vectors import distinct_vectors, matrix, sample, unit, usable
from basketlab.sources.scratch import materialize

COSINE = 0.9
BLOCK = 3000
PIVOTS = 256
SAMPLE = 2048
SEED = 29
_SAFE = 1e-9  # where an inequality decides without a comparison, rounding stays on the careful side


def choose_pivots(found: np.ndarray, wanted: int, cosine: float) -> np.ndarray:
    """Of a sample: centres of dense spots that don't overlap, then evenly others."""
    x = unit(found)
    near = x @ x.T >= np.cos(np.arccos(cosine) / 2)
    count, taken, free = near.sum(axis=1), [], np.ones(len(x), dtype=bool)
    for i in np.argsort(-count, kind="stable"):
        if count[i] < 3 or len(taken) >= wanted:
            break
        if free[i]:
            taken.append(i)
            free &= ~near[i]
    rest = [i for i in range(len(x)) if free[i]][: max(0, wanted - len(taken))]
    return x[taken + rest]


def _held(rows: DataFrame) -> str:
    """The type in which components are carried: the column's floats, else doubles."""
    return "float" if isinstance(rows.schema["vec"].dataType.elementType, T.FloatType) else "double"


def place(classes: DataFrame, pivots: np.ndarray, cosine: float) -> DataFrame:
    """`classes` with cell, ball (0 or 1), near: the other cells it is a boundary vector of."""
    chord = np.sqrt(2 - 2 * cosine)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))
    half = np.cos(np.arccos(cosine) / 2)
    held = _held(classes)
    schema = f"c long, m long, vec array<{held}>, cell int, ball int, near array<int>"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                s = unit(matrix(part.column(2))) @ pivots.T
                cell = s.argmax(axis=1)
                own = s[np.arange(len(s)), cell]
                # distance to the plane between pivots p and q is (s_p - s_q) / |p - q|
                edge = own[:, None] - s <= chord * apart[cell] + _SAFE
                edge[np.arange(len(s)), cell] = False
                near = [np.flatnonzero(e).astype(np.int32) for e in edge]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2).cast(pa.list_(pa.float32() if held == "float" else pa.float64())), pa.array(cell, pa.int32()), pa.array((own >= half + _SAFE).astype(np.int32)), pa.array(near, pa.list_(pa.int32()))],
                    names=["c", "m", "vec", "cell", "ball", "near"],
                )

    return classes.select("c", "m", "vec").mapInArrow(run, schema)


def _deal(placed: DataFrame, blocks: dict[tuple[int, int], int]) -> DataFrame:
    """Rows copied to the block pairs they take part in: a, b, side, c, m, vec."""
    number, of_cell = {}, {}
    for (cell, ball), n in sorted(blocks.items()):
        for i in range(n):
            number[cell, ball, i] = len(number)
            of_cell.setdefault(cell, []).append((ball, number[cell, ball, i]))
    schema = f"a int, b int, side int, c long, m long, vec array<{_held(placed)}>"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                index, a, b, side = [], [], [], []
                for i, (c, cell, ball, near) in enumerate(zip(*(part.column(k).to_pylist() for k in (0, 3, 4, 5)))):
                    me = number[cell, ball, (c * 2654435761 >> 16) % blocks[cell, ball]]
                    to = [n for other, n in of_cell[cell] if not (ball and other)]
                    for q in near:
                        to += [n for _, n in of_cell.get(q, ())]
                    for n in to:
                        index.append(i)
                        a.append(min(me, n))
                        b.append(max(me, n))
                        side.append(0 if me <= n else 1)
                rows = part.take(pa.array(index, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(side, pa.int32()), rows.column(0), rows.column(1), rows.column(2)],
                    names=["a", "b", "side", "c", "m", "vec"],
                )

    return placed.select("c", "m", "vec", "cell", "ball", "near").mapInArrow(run, schema)


def _join_blocks(cosine: float):
    def run(rows: pa.Table) -> pa.Table:
        same = rows.column("a")[0] == rows.column("b")[0]
        side, c, m = (rows.column(k).to_numpy() for k in ("side", "c", "m"))
        x = unit(matrix(rows.column("vec")))
        left = np.ones(len(c), dtype=bool) if same else side == 0
        right = left if same else side == 1
        linked = x[left] @ x[right].T >= cosine
        if same:
            np.fill_diagonal(linked, False)
        nodes = [c[left]] if same else [c[left], c[right]]
        links = [linked @ m[right]] if same else [linked @ m[right], linked.T @ m[left]]
        nodes, links = np.concatenate(nodes), np.concatenate(links)
        a, b = star_links(linked, c[left], c[right])
        some = links > 0
        k = int(some.sum())
        return pa.table(
            {
                "a": pa.array(np.concatenate([nodes[some], a]), pa.int64()),
                "b": pa.array(np.concatenate([np.zeros(k, dtype=np.int64), b]), pa.int64()),
                "n": pa.array(np.concatenate([links[some], np.zeros(len(a), dtype=np.int64)]).astype(np.int64), pa.int64()),
            }
        )

    return run


def near_duplicates(df: DataFrame, key: str, vector: str, cosine: float = COSINE) -> DataFrame:
    """id, n_links, component_id for every row of `df`."""
    rows = materialize(usable(df, key, vector), "embedded")
    classes = distinct_vectors(rows)
    total = classes.count()
    wanted = int(min(PIVOTS, max(1, -(-total // BLOCK))))
    alone = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not total:
        return alone
    pivots = choose_pivots(sample(classes, SAMPLE, SEED), wanted, cosine)
    placed = materialize(place(classes, pivots, cosine), "placed")
    # at most two rows per pivot
    sizes = {(r["cell"], r["ball"]): -(-r["n"] // BLOCK) for r in placed.groupBy("cell", "ball").agg(F.count("*").alias("n")).collect()}
    dealt = _deal(placed, sizes)
    found = materialize(dealt.groupBy("a", "b").applyInArrow(_join_blocks(cosine), "a long, b long, n long"), "found")
    balls = placed.where("ball = 1").groupBy("cell").agg(F.min("c").alias("first"), F.sum("m").alias("all"))
    inside = placed.where("ball = 1").join(balls, "cell")
    counts = found.where("n > 0").select(F.col("a").alias("c"), "n").unionByName(inside.select("c", (F.col("all") - F.col("m")).alias("n")))
    counts = counts.groupBy("c").agg(F.sum("n").alias("n"))
    links = found.where("n = 0").select("a", "b").unionByName(inside.select(F.col("c").alias("a"), F.col("first").alias("b")))
    reach = components(links).withColumnRenamed("node", "c")
    whole = classes.join(counts, "c", "left").join(reach, "c", "left").withColumn("label", F.coalesce("label", "c"))
    whole = materialize(whole.select("c", "vec", "least", "m", "n", "label"), "classes")
    least = whole.groupBy("label").agg(F.min("least").alias("component_id"))
    named = whole.join(least, "label").select("vec", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    return rows.where("ok").join(named, "vec").select("id", "n_links", "component_id").unionByName(alone)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector of the table."""
    found = near_duplicates(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
