"""Exact ids, packing (7) and the wavelet files (9), by round trips."""

import random
import zlib

import numpy as np
import pytest
from llm_rows import SF, hostile, nothing  # noqa: F401
from tokenizers import Tokenizer

from basketlab.llm import packing, wavelet
from basketlab.llm.packing import op7_packing
from basketlab.llm.tokens import Encoder, vocabulary
from basketlab.llm.wavelet import Shard, build, op9_wavelet

FRAGMENTS = ["a", "b2", "É", "é́", " ", "  ", "\n", "\t", "\xa0", ".", ",", "!", "<|endoftext|>", "'s", "'", "S", "12", "_", "ſ", "K", "İ", "Σ", "日本", "|", "?", "<|", "\x1c", "　", "x|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|StartOfText|>", "<|startoftext|>", "²", "́", "word" * 30]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_tokenizers(name):
    rng = random.Random(2)
    texts = ["".join(rng.choices(FRAGMENTS, k=rng.randint(0, 9))) for _ in range(8000)]
    whole = Tokenizer.from_file(vocabulary(name))
    own = Encoder(vocabulary(name), name.startswith("word"))
    for at in range(0, len(texts), 100):
        for t, ids in zip(texts[at : at + 100], own.encode(texts[at : at + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_in_any_case(name):
    whole = Tokenizer.from_file(vocabulary(name))
    own = Encoder(vocabulary(name), name.startswith("word"))
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    forms = [f(a) for a in added for f in (str, str.upper, str.title, str.swapcase)]
    texts = [t for f in forms for t in (f, f"a {f} b", f"a{f}b", f"A.{f}, b", f"{f}{f}", f"one\n{f} two")]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_cache_begun_anew(monkeypatch):
    monkeypatch.setattr("basketlab.llm.tokens.CACHE", 5)
    own, whole = Encoder(vocabulary("byte_bpe_50k.json"), False), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    for t in ["a b c d e f g", "h i. j! k", "a b c", "a. b. " + "z" * 90 + "."]:
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_binary_lengths():
    for n in range(1, 5000):
        parts = packing.lengths(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1024 for p in parts) and parts == sorted(parts, reverse=True)
        assert len([p for p in parts if p < 1024]) == len({p for p in parts if p < 1024})


def check_pieces(rows, texts):
    """rows: of op7; texts: by id, ids that occur once."""
    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    ordered = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in ordered] == sorted((r.length for r in rows), reverse=True)
    assert all(r.offset == 0 for r in rows)
    for doc, text in texts.items():
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        mine = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        at = 0
        for r in mine:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing(spark, hostile, nothing):
    from llm_rows import HOSTILE

    rows = op7_packing(spark, hostile).collect()
    check_pieces(rows, {d[0]: d[1] for d in HOSTILE if d[0] not in (None, 5)})
    assert sum(r.start == 0 for r in rows) == len(HOSTILE)
    assert op7_packing(spark, nothing).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()
    given = op7_packing(spark, SF).collect()
    assert sum(r.length for r in given) > 0
    check_pieces(given, {d.doc_id: d.text for d in docs})


def test_pieces_with_ids(spark, hostile):
    df = spark.read.parquet(f"{hostile}/documents.parquet")
    rows = packing.pieces(df, vocabulary(packing.VOCABULARY), with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)


@pytest.mark.parametrize("high", [1, 2, 300, 49407, 100_000])
def test_wavelet_matrix(high):
    rng = np.random.default_rng(high)
    tokens = np.minimum(rng.geometric(0.01, size=300_000), high).astype(np.uint32)
    shard = Shard(build(tokens, np.array([200_000, 0, 100_000])))
    assert (shard.decode() == tokens).all() and shard.doc_lengths.tolist() == [200_000, 0, 100_000]
    for i in rng.integers(0, len(tokens), 12):
        assert shard.access(int(i)) == tokens[i]
    for t in {int(x) for x in rng.choice(tokens, 5)} | {high + 1}:
        at = np.flatnonzero(tokens == t)
        assert shard.count(t) == len(at) and shard.count(t, 1234) == (at < 1234).sum()
        for k in {0, len(at) // 2, len(at) - 1} if len(at) else ():
            assert shard.select(t, k) == at[k]
        with pytest.raises(IndexError):
            shard.select(t, len(at))
    assert Shard(build(tokens[:0], np.zeros(0))).decode().tolist() == []


def test_shard_holds_ids_of_documents():
    ids = [None, None, -(2**63), -5, -5, 0, 7, 2**63 - 1]
    shard = Shard(build(np.arange(8, dtype=np.uint32), np.ones(8), ids))
    assert [int(i) if known else None for i, known in zip(shard.doc_ids, shard.doc_known)] == ids


def brute(docs):
    whole = Tokenizer.from_file(vocabulary(wavelet.VOCABULARY))
    out, start = [], 0
    for doc, text in docs:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_wavelet_reads_back(spark, hostile, nothing, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD", 500)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted(tuple(r) for r in op9_wavelet(spark, SF).collect())
    assert got == brute(docs)
    odd = op9_wavelet(spark, hostile).collect()
    from llm_rows import HOSTILE

    assert len(odd) == len(HOSTILE)
    ends = sorted((r.start, r.start + r.n_tokens) for r in odd)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert [r.doc_id for r in sorted(odd, key=lambda r: r.start)] == sorted((d[0] for d in HOSTILE), key=lambda x: (x is not None, x or 0))
    assert op9_wavelet(spark, nothing).count() == 0


def test_occurrences(spark):
    shards = wavelet.write_shards(spark.read.parquet(f"{SF}/documents.parquet"), vocabulary(wavelet.VOCABULARY))
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert wavelet.occurrences(shards, 1).groupBy().sum("n").first()[0] >= n
