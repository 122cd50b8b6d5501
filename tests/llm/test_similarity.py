"""Near-copies of the pipeline against exact similarities of shingle sets."""

import random

import numpy as np
from llm_rows import SF
from test_copies import roots

from basketlab.llm import simhash


def shingles(text):
    words = [w.decode("utf-8", "surrogatepass") for w in simhash.words_of(text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """The ids that stay, by components of all pairs at 0.8."""
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j]) >= 0.8]
    root = roots(range(len(rows)), pairs)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[root[n]] = min(i, least.get(root[n], i))
    return sorted(least.values())


def kept(spark, rows):
    return sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def fresh(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_pairs_below_the_similarity_stay(spark):
    rng = random.Random(6)
    rows = []
    for g in range(40):  # a replaced block leaves 0.70 to 0.79
        base = fresh(rng, 204)
        cut = 19 + g % 10
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:60] + fresh(rng, cut) + base[60 + cut :]))]
    assert all(0.72 < alike(shingles(a), shingles(b)) < 0.8 for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    assert kept(spark, rows) == list(range(80))


def test_given_documents_equal_exact_components(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == expected(rows)


def test_repeated_passages_count_once(spark):
    rng = random.Random(8)
    line, one, two, three = fresh(rng, 15), fresh(rng, 154), fresh(rng, 154), fresh(rng, 154)
    passage = three[40:60]
    rows = [
        (0, " ".join(one + line * 20)), (1, " ".join(two + line * 20)),  # alike to 0.05
        (2, " ".join(three)), (3, " ".join(three[:60] + passage * 10 + three[60:])),  # and a copy
    ]
    assert expected(rows) == [0, 1, 2] == kept(spark, rows)


def test_blocks_cut_off_added_or_replaced_are_met(spark):
    rng = random.Random(15)
    rows = []
    for g in range(100):
        base = fresh(rng, 304)
        for k, copy in enumerate((base, base[:246], base + fresh(rng, 72), base[:100] + fresh(rng, 28) + base[128:])):
            rows.append((1000 * k + g, " ".join(copy)))
    missed = 0
    for k in (1, 2, 3):
        part = [r for r in rows if r[0] // 1000 in (0, k)]
        assert all(0.8 <= alike(shingles(part[g][1]), shingles(part[g + 1][1])) < 0.82 for g in range(0, 200, 2))
        missed += len(set(kept(spark, part)) - set(range(100)))
    assert missed <= 3  # of 300; 2 in 1000 are expected


def test_fingerprints_find_copies_without_any_key(spark, monkeypatch):
    monkeypatch.setattr(simhash, "band_keys", lambda h: np.empty(0, dtype=np.int64))
    rng = random.Random(21)
    rows = []
    for g in range(30):
        base = fresh(rng, 1500)
        rows += [(g, " ".join(base)), (100 + g, " ".join(base[:700] + ["changed"] + base[701:]))]
    few = [i for i, t in rows if i < 100 and bin(simhash.majority(np.unique(simhash.hashes(simhash.words_of(t), 5))) ^ simhash.majority(np.unique(simhash.hashes(simhash.words_of(dict(rows)[i + 100]), 5)))).count("1") <= simhash.MAX_BITS]
    assert len(few) > 20
    assert kept(spark, rows) == sorted([*range(30), *(100 + g for g in range(30) if g not in few)])


def test_near_fingerprints_of_unlike_sets_are_no_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "majority", lambda h: 5)  # all fingerprints are equal
    rng = random.Random(22)
    rows = [(i, " ".join(fresh(rng, 30))) for i in range(20)]
    assert kept(spark, rows + [(50, rows[7][1] + " end")]) == list(range(20))


def test_overlaps_equal_sets():
    rng = np.random.default_rng(2)
    sets = [[np.unique(rng.integers(-9000, 9000, size=rng.integers(1, 4000))) for _ in range(n)] for n in (7, 5)]
    want = [[len(np.intersect1d(a, b)) for b in sets[1]] for a in sets[0]]
    assert simhash.overlaps(*sets).tolist() == want
