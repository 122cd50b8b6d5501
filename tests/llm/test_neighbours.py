"""Approximate neighbours (operator 8): recall against brute force, scores exact, parts
that grow in number, not in size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlab.llm import ann

TABLES = "/root/testdata"


def recall(spark, frame, per_part, k=ann.K, every=20):
    rows = frame.collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    got = {}
    for r in ann.search(frame, "vec_id", "embedding", F.col("id") % every == 0, k, per_part).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.score)
    assert set(got) == {i for i in ids if i % every == 0}
    place, hits = {i: n for n, i in enumerate(ids)}, 0
    for q, found in got.items():
        scores = (x * x[place[q]]).sum(axis=1)
        assert sorted(found) == list(range(1, min(k, len(ids) - 1) + 1))
        listed = [found[n] for n in sorted(found)]
        assert all(i != q and s == scores[place[i]] for i, s in listed)
        assert listed == sorted(listed, key=lambda e: (-e[1], e[0]))
        scores[place[q]] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:k]])
        hits += len(best & {i for i, _ in listed})
    return hits / (len(got) * min(k, len(ids) - 1))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_on_given_vectors(spark, folder):
    frame = spark.read.parquet(f"{TABLES}/{folder}/embeddings.parquet").select("vec_id", "embedding")
    assert ann.parts_of(frame.count(), ann.PER_PART) >= ann.FEW
    assert recall(spark, frame, ann.PER_PART) >= 0.9


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_recall_over_two_cuts(spark, spread):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 12))
    x = centres[rng.integers(0, 60, 4000)] + spread * rng.normal(size=(4000, 12))
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert ann.levels_of(4000, 10) == 2
    assert recall(spark, frame, 10, k=5, every=50) >= 0.9


def test_parts_grow_in_number():
    for total in (10, 500, 2000, 50_000, 10**6, 10**9):
        levels = ann.levels_of(total, ann.PER_PART)
        first = ann.parts_of(total, ann.PER_PART)
        assert total / first / ann.PARTS ** (levels - 1) <= ann.SPLIT * ann.PER_PART and 1 <= first <= ann.PARTS
    assert [ann.levels_of(n, ann.PER_PART) for n in (500, 50_000, 10**6, 10**9)] == [1, 1, 2, 3]
