"""Toxicity (1) and quality (5): held-out accuracy, unseen misspellings, odd rows."""

import zlib

import numpy as np
import pytest
from llm_rows import SF, hostile, nothing  # noqa: F401

from basketlab.llm import common, quality, toxicity
from basketlab.llm.quality import op5_quality
from basketlab.llm.toxicity import op1_toxicity

RNG = np.random.default_rng(8)
PLAIN = ["".join(RNG.choice(list("aeiorstnl"), size=RNG.integers(3, 8))) for _ in range(400)]


def texts(n, bad):
    out = []
    for i in range(n):
        words = list(RNG.choice(PLAIN, size=RNG.integers(5, 120)))
        if i % 3 == 0:
            for w in RNG.choice(bad, size=4):
                words.insert(int(RNG.integers(len(words))), str(w))
        out.append((" ".join(map(str, words)), int(i % 3 == 0)))
    return out


def test_unseen_misspellings_are_caught():
    model = toxicity.fit(texts(600, ["zimbawker", "zimbawking", "quxgrunt", "quxgrunts"]), {0: 400, 1: 200})
    values = toxicity._Words(model)
    held = texts(300, ["zimbawked", "quxgrunting", "quxgruntt"])
    right = [(toxicity.score_text(t, values) >= 0.5) == bool(y) for t, y in held]
    assert np.mean(right) > 0.97
    long = " ".join(PLAIN * 60)
    assert toxicity.score_text(long, values) < 0.5 <= toxicity.score_text(long + " zimbawked quxgruntt " + long, values)


def plain_score(text, model):
    """Window by window, word by word, n-gram by n-gram."""
    words = text.split()
    means = []
    for at in range(max(1, len(words) - toxicity.WINDOW + 1)):
        window = words[at : at + toxicity.WINDOW]
        if window:
            values = [sum(model.logit[g] for g in toxicity.subwords(w)) / len(toxicity.subwords(w)) for w in window]
            means.append(sum(values) / len(values))
    return 1 / (1 + np.exp(-(max(means, default=0.0) + model.bias)))


def test_score_equals_loop_and_bears_words_in_front():
    model = toxicity.fit(texts(300, ["zimbawker", "quxgrunt"]), {0: 200, 1: 100})
    values = toxicity._Words(model)
    for text, _ in [*texts(60, ["zimbawked", "quxgruntt"]), ("", 0), ("one", 0), ("one two three", 0), (" \n ", 0)]:
        score = toxicity.score_text(text, values)
        assert score == pytest.approx(plain_score(text, model), abs=1e-9)
        if len(text.split()) >= toxicity.WINDOW:
            # windows of the text itself stay, so a word in front can only add one
            assert toxicity.score_text(f"{PLAIN[0]} {text}", values) >= score - 1e-9


def test_a_word_in_front_hardly_moves_given_scores(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    values = toxicity._Words(model)
    held = [r.text or "" for r in docs.where(toxicity.held_out()).select("text").collect()]
    moved = [abs(toxicity.score_text("the " + t, values) - toxicity.score_text(t, values)) for t in held]
    assert len(held) > 100 and max(moved) < 0.05


def test_toxic_accuracy_on_given_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in op1_toxicity(spark, folder).collect() if r.held_out and labels.get(r.doc_id) is not None]
    assert len(rows) > 50 and np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.9


def test_score_is_in_range_and_empty_texts_are_clean(spark, hostile):
    rows = op1_toxicity(spark, hostile).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id != 5}
    assert by[1].score == by[2].score == by[3].score
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert not by[None].held_out


def test_interactions_equal_the_double_sum():
    rng = np.random.default_rng(1)
    width = quality.BUCKETS + len(quality.STATISTICS)
    model = quality.Model(0.3, rng.normal(size=width) * 0.1, rng.normal(size=(width, quality.RANK)) * 0.1, np.zeros(len(quality.STATISTICS)), np.ones(len(quality.STATISTICS)))
    text = "One two two three!! | four\nfive"
    ids, x, stats = quality.features(text, quality._Buckets())
    s = np.clip(np.array(stats), -8, 8)
    index = np.concatenate([ids, np.arange(quality.BUCKETS, width)])
    value = np.concatenate([x, s])
    z = model.w0 + sum(model.w[i] * v for i, v in zip(index, value))
    z += sum(model.v[index[i]] @ model.v[index[j]] * value[i] * value[j] for i in range(len(index)) for j in range(i))
    assert quality.score_text(text, model, quality._Buckets()) == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_learns_structure():
    good = [(" ".join(map(str, RNG.choice(PLAIN, size=60))) + ".", 1) for _ in range(200)]
    bad = [(" ".join([str(RNG.choice(PLAIN)).upper() + "!!"] * 60), 0) for _ in range(100)]
    model = quality.fit(good[:150] + bad[:75], {0: 75, 1: 150})
    b = quality._Buckets()
    assert all(quality.score_text(t, model, b) >= 0.7 for t, _ in good[150:])
    assert all(quality.score_text(t, model, b) < 0.7 for t, _ in bad[75:])


def test_quality_of_odd_rows(spark, hostile):
    rows = op5_quality(spark, hostile).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)


@pytest.mark.parametrize("op", [op1_toxicity, op5_quality])
def test_empty_tables(spark, nothing, op):
    df = op(spark, nothing)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"] and df.count() == 0


def test_one_class_only():
    for module in (toxicity, quality):
        assert module.fit([("a b", 0)], {0: 1}) and module.fit([("a b", 1), ("", 1)], {1: 2})


def test_held_out_accuracy_on_given_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in op5_quality(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert rows and np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.9


def test_a_task_fits_and_the_driver_gets_the_model_alone(spark, monkeypatch, nothing):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows, counts = common.labelled_sample(docs, labels, "toxic", ~toxicity.held_out(), toxicity.PER_CLASS, toxicity.MAX_CHARS, toxicity.SEED)
    here, fit = [], toxicity.fit
    expected = fit(rows, counts)

    def noted(*args):
        here.append(args)  # of the process that fits
        return fit(*args)

    monkeypatch.setattr(toxicity, "fit", noted)
    model = toxicity.train(docs, labels)
    assert not here and model.bias == expected.bias and np.array_equal(model.logit, expected.logit) and model.logit.any()
    empty = toxicity.train(*(spark.read.parquet(f"{nothing}/{n}.parquet") for n in ("documents", "labels")))
    assert not empty.logit.any() and empty.bias == -40
