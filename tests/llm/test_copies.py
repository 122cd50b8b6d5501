"""SimHash (10), components and the metric join (6) against brute force."""

import random

import numpy as np
import pytest
import xxhash
from llm_rows import SF, hostile, nothing  # noqa: F401
from pyspark.sql import functions as F

from basketlab.llm import metric_join, simhash
from basketlab.llm.blocks import star_links
from basketlab.llm.components import components
from basketlab.llm.metric_join import op6_embedding_near_dedup
from basketlab.llm.simhash import op10_simhash_near_dedup


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text, width=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c == " " or "\t" <= c <= "\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rng = random.Random(4)
    bits = ["a", "B", "É", "k", "\x0b", "\xa0", " ", "\n", "zz", "\x1c", " "]
    for _ in range(400):
        text = "".join(rng.choices(bits, k=rng.randint(0, 60)))
        assert simhash.fingerprint(text, 3) == plain_fingerprint(text)
    long = " ".join(str(rng.random()) for _ in range(40_000))
    assert simhash.fingerprint(long, 3) == plain_fingerprint(long)


def test_spark_hash_is_the_same(spark):
    for s in ("", "a b c", "é ü 日"):
        h = spark.range(1).select(F.xxhash64(F.lit(s)).alias("h")).first().h
        assert h % 2**64 == xxhash.xxh64_intdigest(s.encode(), 42)


def linked(fps):
    x = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    return [(fps[i], fps[j]) for i, j in zip(*np.nonzero(near)) if i < j]


@pytest.mark.parametrize("hot,block", [(128, 1024), (4, 16)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, hot, block):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for base in list(fps)[:12]:  # chains, dense groups, and pairs at 3 and 4 bits
        for _ in range(25):
            f = base
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r.node: r.label for r in components(links).collect()}
    want = roots(signed, [(signed[fps.index(a)], signed[fps.index(b)]) for a, b in linked(fps)])
    assert {n: got.get(n, n) for n in signed} == want


def broadcast_nodes(frame):
    """Names of the plan's nodes whose rows go to the driver to be broadcast."""

    def walk(node, inside):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            yield from walk(node.initialPlan(), inside)
        if inside:
            yield name
        children = node.children()
        for i in range(children.size()):
            yield from walk(children.apply(i), inside or name == "BroadcastExchange")

    return set(walk(frame._jdf.queryExecution().executedPlan(), False))


@pytest.fixture
def written(monkeypatch):
    """The tables that simhash writes between its steps."""
    frames, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: write(frames.append(df) or df, name))
    return frames


@pytest.mark.parametrize("hot", [128, 4])
def test_looked_up_keys_are_not_broadcast(spark, monkeypatch, written, hot):
    # 17 keys a segment on average, taken for as small as the fingerprints they come from
    monkeypatch.setattr(simhash, "HOT", hot)
    fps = simhash.materialize(spark.range(300).select((F.col("id") * 2**30).alias("fp")), "fps")
    links = simhash.links(fps)
    assert written[1].isEmpty() == (hot == 128)
    assert not any("Generate" in broadcast_nodes(df) for df in [*written, links])


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 180)] + [(1, x) for x in range(2, 40)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(90)]
    frame = spark.createDataFrame(pairs + [(7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in components(frame).collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    assert {n: got.get(n, n) for n in want} == want
    assert components(frame.limit(0)).count() == 0


def test_star_links():
    rng = np.random.default_rng(3)
    left, right = np.arange(40), np.arange(100, 150)
    grid = rng.random((40, 50)) < 0.02
    a, b = star_links(grid, left, right)
    nodes = [*left, *right]
    assert roots(nodes, zip(a, b)) == roots(nodes, [(left[i], right[j]) for i, j in zip(*np.nonzero(grid))])
    assert len(a) <= 90


def test_simhash_query(spark, hostile, nothing):
    for folder in (SF, hostile):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        fp = [plain_fingerprint(t) for _, t in docs]
        root = roots(set(fp), linked(sorted(set(fp))))
        least = {}
        for (d, _), f in zip(docs, fp):
            if d is not None:
                least[root[f]] = min(d, least.get(root[f], d))
        want = sorted(((str(d), f"{f:016x}", str(least.get(root[f]))) for (d, _), f in zip(docs, fp)))
        assert sorted(tuple(map(str, r)) for r in op10_simhash_near_dedup(spark, folder).collect()) == want
    assert op10_simhash_near_dedup(spark, nothing).count() == 0


def test_keep_one_broadcasts_nothing_exploded(spark, written):
    rows = [(i, " ".join(f"w{i // 2 * 100 + j}" for j in range(60)) + " more" * (i % 2)) for i in range(40)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))
    assert not any("Generate" in broadcast_nodes(df) for df in [*written, kept])


def test_keep_one_of_odd_rows(spark, hostile, nothing):
    docs = spark.read.parquet(f"{hostile}/documents.parquet")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # the empty texts, the clean text and its copies, and one row each of the others
    assert sorted(ids) == [-3, 1, 4, 5, 5, 8, 9]
    assert simhash.keep_one(spark.read.parquet(f"{nothing}/documents.parquet")).count() == 0


@pytest.mark.parametrize("hot,block", [(32, 1024), (4, 16)])
def test_keep_one_by_similarity(spark, monkeypatch, hot, block):
    monkeypatch.setattr(simhash, "WIDE_HOT", hot)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, rows, group = fresh(60), [], {}
    for g in range(25):
        base = fresh(rng.randint(120, 300))
        if g < 10:
            base[20:80] = shared  # a passage in common makes no copy
        for k in range(40 if g == 3 else 3):
            copy = list(base)
            for _ in range(0 if k == 0 else max(1, len(base) // 130)):
                copy[rng.randrange(len(copy))] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    kept = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    assert sorted(kept) == sorted(first.values())


def brute_links(ids, x, ok):
    n = len(ids)
    u = np.zeros_like(x)
    u[ok] = x[ok] / np.linalg.norm(x[ok], axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ok[:, None] & ok[None, :]
    np.fill_diagonal(near, False)
    root = roots(range(n), [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    least = {}
    for i, r in root.items():
        least[r] = min(ids[i], least.get(r, ids[i]))
    return sorted((ids[i], int(near[i].sum()), least[root[i]], ids[i] == least[root[i]]) for i in range(n))


@pytest.mark.parametrize("block", [3000, 40])
def test_metric_join_equals_all_pairs(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(metric_join, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(260, 16))
    x[60:140] = x[3] + rng.normal(size=(80, 16)) * 0.15  # a dense group
    x[140:200] = x[4] + rng.normal(size=(60, 16)) * 0.4  # links near the threshold
    x[200:230] = x[5] * rng.uniform(0.1, 9, size=(30, 1))  # equal directions
    x[230:240] = x[6]
    x = x.astype(np.float32)
    ids = [int(i) for i in rng.permutation(260)]
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<float>")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in op6_embedding_near_dedup(spark, str(tmp_path)).collect())
    assert got == brute_links(ids, x.astype(np.float64), np.ones(260, dtype=bool))


def test_metric_join_of_odd_rows(spark, hostile, nothing):
    rows = op6_embedding_near_dedup(spark, hostile).collect()
    assert len(rows) == 14
    by = {r.vec_id: r for r in rows if r.vec_id != 2}
    assert [by[i].n_links for i in (3, 4, 5, 6, 7, 8, 9)] == [0] * 7 and all(by[i].kept for i in (3, 4, 5, 6, 7, 8, 9))
    assert by[1].n_links == 4 and by[40].component_id == 1 and by[None].component_id == 1
    assert by[20].n_links == by[21].n_links == 1 and by[21].component_id == 20
    assert op6_embedding_near_dedup(spark, nothing).count() == 0
