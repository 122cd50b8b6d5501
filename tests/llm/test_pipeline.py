"""The pipeline on odd rows, and its parts against brute force."""

import hashlib
import zlib

import corpus_pipeline
import numpy as np
from llm_rows import CLEAN, DOCS, EXTRA, SF, hostile, nothing, write  # noqa: F401

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketlab.llm import mixing, secrets, simhash, toxicity
from basketlab.llm.packing import lengths
from basketlab.llm.queries import QUERIES
from basketlab.llm.tokens import vocabulary
from basketlab.sources.scratch import materialize


def test_stages_keep_columns(spark, hostile, nothing):
    for folder in (hostile, nothing):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            docs = spark.createDataFrame(out.collect(), DOCS)
        assert corpus_pipeline.run(spark, folder).columns[0:1] and corpus_pipeline.run(spark, folder).count() >= 0


def alike(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def least_of_groups(texts):
    """The smallest id of each group of texts whose 5-word sets link at 0.8."""
    sets = {i: set(simhash.hashes(simhash.words_of(t or ""), 5).tolist()) for i, t in texts.items()}
    least = {i: i for i in texts}
    for i in sorted(texts):
        for j in sorted(texts):
            if j < i and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and alike(sets[i], sets[j]) >= 0.8:
                a, b = sorted((least[i], least[j]))
                least = {k: a if v == b else v for k, v in least.items()}
    return set(least.values())


def bought(rows, plan):
    """Ids that one epoch of the plan's budgets takes: (doc_id, leaf, tokens, digest)."""
    out = set()
    for leaf, (budget, tokens) in plan.items():
        mine = [r for r in rows if r[1] == leaf]
        if tokens and budget >= tokens:
            out |= {r[0] for r in mine}
            continue
        spent = 0
        for doc, _, n, digest in sorted(mine, key=lambda r: (hashlib.md5(f"{mixing.SEED}|1|{r[0]}|{r[3]}".encode()).hexdigest(), r[0])):
            if spent >= budget:
                break
            out.add(doc)
            spent += n
    return out


def test_stages_equal_brute_force(spark):
    """Each stage on its own input, whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    values = toxicity._Words(model)
    given = {r.doc_id: r.text for r in docs.collect()}

    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts == {i: t for i, t in given.items() if toxicity.score_text(t or "", values) < toxicity.THRESHOLD}
    assert 0.8 * len(given) < len(texts) < len(given)

    single = corpus_pipeline.drop_copies(spark, clean, SF)
    kept = {r.doc_id: r.text for r in single.collect()}
    assert set(kept) == least_of_groups(texts) and len(kept) < len(texts)

    safe = corpus_pipeline.replace_secrets(spark, single, SF)
    redacted = {r.doc_id: r.text for r in safe.collect()}
    assert redacted == {i: None if t is None else secrets.redact(t) for i, t in kept.items()}

    mixed = corpus_pipeline.mix_sources(spark, safe, SF)
    narrow = mixing.narrow(safe, [])
    plan = mixing.budgets(narrow.groupBy(*mixing.LEVELS).agg(F.sum("tokens").alias("tokens")), corpus_pipeline.MIX_PERCENT, 1)
    leaves = {tuple(r[c] for c in mixing.LEVELS): (r.budget, r.tokens) for r in plan.collect()}
    rows = [(r.doc_id, tuple(r[c] for c in mixing.LEVELS), r.tokens, r.digest) for r in narrow.collect()]
    assert {r.doc_id for r in mixed.collect()} == bought(rows, leaves)
    total, spent = sum(r[2] for r in rows), sum(b for b, _ in leaves.values())
    # budgets are whole numbers, rounded down
    assert 0 <= total * corpus_pipeline.MIX_PERCENT // 100 - spent <= len(leaves)

    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.pack_pieces(spark, mixed, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for r in mixed.collect():
        ids = np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        ends = np.cumsum(lengths(len(ids)))
        assert sorted(pieces.pop(r.doc_id)) == [(int(e - n), n, zlib.crc32(ids[e - n : e])) for e, n in zip(ends, lengths(len(ids)))]
    assert not pieces


def test_run_chains_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "stage")
    pick = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(pick).collect())) == sorted(map(tuple, docs.select(pick).collect()))


def test_helper_columns_give_way_to_the_tables_own(spark, hostile):
    names = ["row", "_row", "keys", "print", "clean", "toxic", "TEXT_"]
    docs = spark.read.parquet(f"{hostile}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(n).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, hostile), name)
        assert all(r[n] == n for r in docs.collect() for n in names), name


def test_copies_and_toxic_texts_go_and_clean_ones_stay(spark, tmp_path):
    bad = "you utter moron and idiot, worthless scum of a clown"
    rows = [(i, f"{CLEAN} {i} {i * 7} {i * 13} {' '.join(str(i * k) for k in range(40))}", "en", "src1", 1) for i in range(60)]
    rows += [(100 + i, f"{bad} {i} {CLEAN} {i * 3}", "en", "src2", 1) for i in range(30)]
    rows += [(200 + i, rows[i][1], "en", "src3", 1) for i in range(10)]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 1, 1) for i in range(0, 30, 2)]
    folder = write(spark, tmp_path / "t", rows, labels)
    docs = spark.createDataFrame([r + EXTRA for r in rows], DOCS)
    docs = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert {r.doc_id for r in docs.collect()} == set(range(60)) | set(range(200, 210))
    assert {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, folder).collect()} == set(range(60))


def test_all_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and len(QUERIES) == 14
