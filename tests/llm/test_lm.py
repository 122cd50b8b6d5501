"""The attention model against plain loops, and the query's counts against a plain loop."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import SF, hostile, nothing  # noqa: F401

from basketlab.llm import lm
from basketlab.llm.tokens import vocabulary

PATH = vocabulary(lm.VOCABULARY)


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 3, (lm.SUBWORDS, lm.SUBWORDS)) * (rng.random((lm.SUBWORDS, lm.SUBWORDS)) < 0.02)
    weights = lm.fresh() * np.float32(1.5)
    return weights, lm.counted(pairs)


def texts(draw, sizes):
    return [np.array([draw.randrange(lm.END) for _ in range(n)] + [lm.END], dtype=np.uint16) for n in sizes]


def joined(made):
    return np.concatenate(made), np.array([len(t) for t in made])


def plain_logs(weights, c, text):
    """Log chance of each id of a text, and the sum of all ids' chances, one by one."""
    E, P, Wq, Wk, Wv, U = (p.astype(np.float64) for p in lm.parts(weights))
    before = [lm.END, *text[:-1].tolist()]
    out, totals = [], []
    for t, target in enumerate(text.tolist()):
        begin = t // lm.STEP * lm.STEP - lm.LEAD  # of the window that scores t
        held = [(j - begin, before[j]) for j in range(max(0, begin), t + 1)]
        place, own = held[-1]
        q = (E[own] + P[place]) @ Wq / math.sqrt(lm.DIM)
        s = np.array([q @ ((E[i] + P[p]) @ Wk) for p, i in held])
        a = np.exp(s - s.max())
        a /= a.sum()
        o = sum(w * ((E[i] + P[p]) @ Wv) for w, (p, i) in zip(a, held))
        z = c.by_class[own] + o @ U
        classes = np.exp(z - z.max())
        classes /= classes.sum()
        chances = classes[c.group] * np.exp(c.within[own].astype(np.float64))
        totals.append(chances.sum())
        out.append(math.log(chances[target]))
    return out, totals


def test_windows_score_each_id_once_as_loops_do(model):
    made = texts(random.Random(2), [0, 1, lm.STEP - 1, lm.STEP, lm.STEP + 1, 70])
    found = lm.Scorer(*model).logs(*joined(made))
    expected, totals = zip(*(plain_logs(*model, t) for t in made))
    assert len(found) == sum(map(len, made))
    np.testing.assert_allclose(found, np.concatenate(expected), rtol=2e-4, atol=2e-4)
    np.testing.assert_allclose(np.concatenate(totals), 1, atol=1e-4)


def test_windows_mask_what_comes_later(model):
    a, b = texts(random.Random(3), [50, 50])
    b[:30] = a[:30]
    scorer = lm.Scorer(*model)
    np.testing.assert_allclose(scorer.logs(*joined([a]))[:30], scorer.logs(*joined([b]))[:30], rtol=1e-5)
    assert not np.allclose(scorer.logs(*joined([a]))[30:], scorer.logs(*joined([b]))[30:])


def test_gradient_equals_differences(model):
    weights, c = model[0].astype(np.float64), model[1]
    ids, targets = lm.windows(*joined(texts(random.Random(4), [3, 40])))
    value, gradient = lm.loss(weights, c, ids.astype(np.int64), targets.astype(np.int64))
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.choice(np.flatnonzero(gradient[a : a + n]) + a, 12) for a, n in zip(np.cumsum([0, *lm._SIZES]), lm._SIZES)])
    for i in at:
        moved = [weights.copy(), weights.copy()]
        moved[0][i] -= 1e-5
        moved[1][i] += 1e-5
        low, high = (lm.loss(w, c, ids, targets)[0] for w in moved)
        assert (high - low) / 2e-5 == pytest.approx(gradient[i], rel=1e-3, abs=1e-7)


def test_training_learns_from_what_stands_far_back():
    """The first id of a pattern decides its fourth: neighbours alone can't know."""
    draw = random.Random(6)
    made = []
    for _ in range(300):
        kinds = [draw.randrange(2) for _ in range(12)]
        made.append(np.array([x for k in kinds for x in (300 + k, 400, 401, 500 + k)] + [lm.END], dtype=np.uint16))
    pairs = np.zeros((lm.SUBWORDS, lm.SUBWORDS))
    for t in made:
        np.add.at(pairs, (t[:-1], t[1:]), 1)
    c = lm.counted(pairs)
    c.group[:] = np.arange(lm.SUBWORDS) % lm.CLASSES
    c = lm.Counted(c.group, np.full_like(c.by_class, -math.log(lm.CLASSES)), np.full_like(c.within, -math.log(lm.SUBWORDS / lm.CLASSES)))
    ids, targets = lm.windows(*joined(made[:200]))
    cuts = [slice(a, a + 16) for _ in range(25) for a in range(0, len(ids), 16)]
    weights = lm.train_on(lm.fresh(), c, ((ids[x].astype(int), targets[x].astype(int)) for x in cuts))
    logs = lm.Scorer(weights, c).logs(*joined(made[200:])).reshape(100, -1)[:, :-1].reshape(100, 12, 4)[:, 3:, 3]
    assert logs.mean() - math.log(lm.CLASSES / lm.SUBWORDS) > -0.2


def base(docs):
    """doc -> (held out, n_tokens, n_known, N, base) by loops."""

    def words(text):
        return [*(text or "").encode().lower().split(), b""]

    def out(doc):
        return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2

    c = Counter(w for doc, text in docs if doc is not None and not out(doc) for w in words(text))
    n, v = sum(c.values()), len(c)
    rows = []
    for doc, text in docs:
        ws = words(text)
        rows.append((doc, out(doc), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)))
    return rows


@pytest.mark.parametrize("folder", ["given", "hostile", "nothing"])
@pytest.mark.parametrize("few", [False, True])
def test_query_counts_equal_loop(spark, request, monkeypatch, folder, few):
    if few:  # most words take the join
        monkeypatch.setattr(lm, "COMMON", 3)
    folder = SF if folder == "given" else request.getfixturevalue(folder)
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = lm.op12_lm_scoring(spark, folder).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    rows = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=key)
    expected = sorted(base(docs), key=key)
    assert [r[:5] for r in rows] == [r[:5] for r in expected]
    assert [r[5] for r in rows] == pytest.approx([r[5] for r in expected], rel=1e-9)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_join_and_broadcast_give_one_score(spark, monkeypatch):
    """A word's count counts the same whichever way it comes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model, counts = lm.learn(docs, PATH)
    whole = {r.doc_id: r.score for r in lm.scored(docs, model, counts, PATH).collect()}
    few = lm.Model(model.weights, model.counted, {w: n for w, n in model.common.items() if n > 500})
    assert {r.doc_id: r.score for r in lm.scored(docs, few, counts, PATH).collect()} == pytest.approx(whole, rel=1e-6)


def test_model_beats_neighbours_and_words_on_held_out_documents(spark):
    found = [r for r in lm.op12_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(found) > 100
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model, _ = lm.learn(docs, PATH)
    plain = model.weights.copy()
    plain[-lm._SIZES[-1] :] = 0  # neighbours alone
    known = lm.Words(PATH)
    made = known.subwords(*known.numbers([(r.text or "").encode() for r in docs.where(lm.held_out()).collect()]))
    learned, alone = (lm.Scorer(w, model.counted).logs(*made).mean() for w in (model.weights, plain))
    assert learned > alone + 0.05


def test_every_window_of_every_training_document_is_trained_on_once(spark, monkeypatch):
    averaged, rounds = lm._averaged, []

    def noted(rows):
        rounds.append(sum(r.n for r in rows.select("n").collect()))
        return averaged(rows)

    monkeypatch.setattr(lm, "_averaged", noted)
    monkeypatch.setattr(lm, "TRAINER", 700)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lm.learn(docs, PATH)
    known = lm.Words(PATH)
    texts_ = [(r.text or "").encode() for r in docs.where(~lm.held_out()).collect()]
    made = len(lm.windows(*known.subwords(*known.numbers(texts_)))[0])
    assert len(rounds) == lm.ROUNDS and all(rounds) and sum(rounds) == made


def test_mixed_batches_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(lm, "TRAINER", 50)
    texts_ = [f"word{i} " * (i % 40) for i in range(700)]
    batch = lm.pa.RecordBatch.from_arrays([lm.pa.array(range(700)), lm.pa.array([t.encode() for t in texts_], lm.pa.binary())], names=["doc_id", "text"])
    known = lm.Words(PATH)
    got = [np.concatenate(x, axis=1) for x in lm.mixed_batches(iter([batch]), known, np.random.default_rng(1))]
    want = np.concatenate(lm.windows(*known.subwords(*known.numbers([t.encode() for t in texts_]))), axis=1)
    assert sorted(map(bytes, np.concatenate(got).astype("<u2"))) == sorted(map(bytes, want.astype("<u2")))


def test_steps_write_into_the_same_arrays(model):
    """Steps of other sizes between don't matter, and little is allocated anew."""
    weights, c = model
    many, few = ([x.astype(np.int64) for x in lm.windows(*joined(texts(random.Random(s), n)))] for s, n in ((8, [300] * 60), (9, [5, 90])))
    room = lm.Room()
    for ids, targets in (many, few, many):
        value, gradient = lm.loss(weights, c, ids, targets, room)
        fresh, expected = lm.loss(weights, c, ids, targets)
        assert value == pytest.approx(fresh, rel=1e-6)
        np.testing.assert_allclose(gradient, expected, rtol=1e-4, atol=1e-8)
    tracemalloc.start()
    lm.loss(weights, c, *many, room)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(x.nbytes for x in room.values()) / 3


def test_a_worker_spells_a_word_once(monkeypatch):
    known = lm.kept_words(PATH)
    known.forget()
    texts_ = [b"once more the same words", b"the same words"]
    batch = lm.pa.RecordBatch.from_arrays([lm.pa.array([1, 2]), lm.pa.array(texts_, lm.pa.binary())], names=["doc_id", "text"])
    first = [x.copy() for x in next(lm.mixed_batches(iter([batch]), lm.kept_words(PATH), np.random.default_rng(1)))]
    monkeypatch.setattr(known, "encode", None)  # not called again by the next task
    again = next(lm.mixed_batches(iter([batch]), lm.kept_words(PATH), np.random.default_rng(1)))
    assert known.names == b"once more the same words".split()
    assert all((a == b).all() for a, b in zip(first, again))
    known.forget()
