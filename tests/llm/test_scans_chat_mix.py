"""Secrets (3), chat (4), mixing (2) and neighbours (8)."""

import base64
import hashlib
import json

import numpy as np
import pytest
from llm_rows import HOSTILE, SF, hostile, nothing  # noqa: F401
from pyspark.sql import functions as F

from basketlab.llm import chat, mixing, secrets
from basketlab.llm.ann import op8_ann
from basketlab.llm.chat import op4_chat
from basketlab.llm.mixing import op2_mixing
from basketlab.llm.secrets import op3_secrets, scan
from checks.compare import compare, duck


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x80 | (len(body).bit_length() + 7) // 8]) + len(body).to_bytes((len(body).bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


INT = lambda n, size=1: der(2, n.to_bytes(size, "big"))
RSA = der(0x30, INT(0), *[INT(3 + i, 40) for i in range(8)])
PKCS8 = der(0x30, INT(0), der(0x30, der(6, b"\x2a\x86\x48"), der(5)), der(4, RSA))
EC = der(0x30, INT(1), der(4, bytes(range(32))), der(0xA0, der(6, b"\x2a\x86")))
FIELD = lambda b: len(b).to_bytes(4, "big") + b
OPENSSH = b"openssh-key-v1\0" + FIELD(b"none") + FIELD(b"none") + FIELD(b"") + (1).to_bytes(4, "big") + FIELD(b"p" * 30) + FIELD(b"s" * 60)
URL = lambda o: base64.urlsafe_b64encode(o if isinstance(o, bytes) else json.dumps(o).encode()).rstrip(b"=").decode()
JWT = f"{URL({'alg': 'HS256'})}.{URL({'sub': '1'})}.{URL(b'x' * 32)}"


def kinds(text):
    return [k for k, _, _ in scan(text)]


@pytest.mark.parametrize("data,kind", [(RSA, "der_key"), (PKCS8, "der_key"), (EC, "der_key"), (OPENSSH, "openssh_key")])
def test_keys_in_every_encoding(data, kind):
    b64 = base64.b64encode(data).decode()
    lines = "\n".join(b64[i : i + 64] for i in range(0, len(b64), 64))
    assert kind in kinds(f"see {b64} here")
    assert kind in kinds(f"a\n-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----\nb")
    assert kinds(f"see {data.hex()} here") == ["hex", kind]
    broken = base64.b64encode(data[:-1]).decode()
    assert kinds(f"see {broken} here") == []
    assert kind not in kinds(f"-----BEGIN KEY-----\n{broken}\n-----END KEY-----")
    assert kind not in kinds(f"see {data[:-2].hex()} here")


def test_signed_tokens():
    text = f"Bearer {JWT}, ok"
    assert scan(text) == [("signed_token", 7, 7 + len(JWT))]
    assert kinds(JWT.replace(URL({"alg": "HS256"}), URL({"typ": "JWT but no algorithm"}))) == []
    assert kinds(f"{URL(b'not json at all')}.{URL({'a': 1})}.abcd1234") == []
    assert kinds(f"{URL({'alg': 'none', 'pad': 'x' * 20})}.{URL({'a': 1})}.") == ["signed_token"]


def test_base_spans():
    assert kinds("secret: token: abcdefgh12") == []  # the first match fails and has eaten the second
    assert scan("é API_Key='abcdefgh'") == [("assign", 2, 19)]
    assert kinds("paſsword=abcdefgh1 ") == []
    assert kinds("AKIA" + "A" * 11) == [] and kinds("AKIA" + "A" * 12) == ["access"]
    assert kinds("a" * 31) == [] and kinds("g" + "a" * 32) == ["hex"]


def test_secrets_query(spark, hostile, nothing):
    for folder in (SF, hostile):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        want = sorted((str(d.doc_id), *secrets.brute(d.text or "")) for d in docs)
        got = [(str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in op3_secrets(spark, folder).collect()]
        assert sorted(got) == want
    assert op3_secrets(spark, nothing).count() == 0


def test_redacted(spark, hostile):
    docs = spark.read.parquet(f"{hostile}/documents.parquet")
    out = secrets.redacted(docs)
    assert out.columns == docs.columns and out.count() == len(HOSTILE)
    changed = out.where("doc_id = 8").first()
    assert changed.text == "[assign removed]\" and [access removed] <|endoftext|> é" and changed.n_chars == len(changed.text)
    same = {r.text for r in out.where("doc_id <> 8 or doc_id is null").collect()}
    assert same == {d[1] for d in HOSTILE if d[0] != 8}


def test_chat_folds_events(spark):
    rows = [
        (1, 1, "a", "message", "user", "hi"), (1, 2, "b", "delta", "assistant", "wr"), (1, 3, "b", "delta", "assistant", "ong"),
        (1, 4, "c", "message", "user", "what?"), (1, 5, "b", "regenerate", "assistant", None), (1, 6, "b", "delta", None, "right"),
        (1, 7, "a", "edit", "user", "hello"), (1, 8, "d", "message", "user", "thanks"), (2, 1, "z", None, None, None),
    ]
    events = spark.createDataFrame(rows[::-1], "conv_id int, seq long, message string, kind string, role string, text string")
    said = {r.conv_id: [(t.role, t.text, t.loss) for t in r.said] for r in chat.read_back(chat.render(chat.fold(events))).collect()}
    assert said[1] == [("user", "hello", False), ("assistant", "right", True), ("user", "thanks", False)]
    assert said[2] == [("", "", False)]


def test_chat_escapes_are_undone(spark):
    import random

    rng = random.Random(6)
    bits = ["<", "|", "\\", "n", "\n", "<|im_end|>", "<|im_start|>", "assistant", " ", "é", "<\\|", "\\\\"]
    pick = lambda: "".join(rng.choices(bits, k=rng.randint(0, 8)))
    rows = [(i, t, str(t), "message", rng.choice([pick(), "assistant"]), pick()) for i in range(80) for t in range(3)]
    frame = spark.createDataFrame(rows, "conv_id int, seq long, message string, kind string, role string, text string")
    done = chat.render(chat.fold(frame))
    for r in chat.read_back(done).collect():
        assert [(t.role, t.text) for t in r.said] == [(x[4], x[5]) for x in rows if x[0] == r.conv_id]
    for r in done.collect():  # the offsets hold in the text itself
        for t, x in zip(r.turns, [x for x in rows if x[0] == r.conv_id]):
            assert r.formatted[t.start : t.end] == x[5].replace("\\", "\\\\").replace("<|", "<\\|") and t.loss == (x[4] == "assistant")


def test_chat_is_native(spark):
    plan = op4_chat(spark, SF)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_chat_against_sql(spark, hostile):
    assert compare(spark, duck(SF), op4_chat, chat.OP4_SQL, SF) == ""
    rows = {r.conv_id: r for r in op4_chat(spark, hostile).collect()}
    assert set(rows) == {-1, 0, None, 2, 3} and rows[0].n_turns == 3 and rows[None].n_turns == 2
    assert rows[0].turns_sha256 == hashlib.sha256(b"user\none\nassistant\ntwo\nassistant\ntwo\n").hexdigest()
    assert rows[0].loss_chars == 6 and rows[-1].loss_sha256 == hashlib.sha256(b"<|im_end|><|im_start|>assistant ok").hexdigest()


def test_empty_log(spark, nothing):
    assert [r.conv_id for r in op4_chat(spark, nothing).collect()] == [-1]


def test_mixing_against_sql(spark):
    assert compare(spark, duck(SF), op2_mixing, mixing.OP2_SQL, SF) == ""


def test_budgets_fill_siblings_first(spark):
    leaves = [("web", "en", "src0", 100), ("web", "en", "src1", 10_000), ("web", "de", "src2", 50), ("forum", "en", "src20", 20_000)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {r.source: int(r.budget) for r in mixing.budgets(frame, 50, 1).collect()}
    # 15075 in all; web may have 5/7 of it but holds 10150, so forum gets the rest
    assert got == {"src0": 100, "src1": 10_000, "src2": 50, "src20": 15_075 - 10_150}
    got = {r.source: int(r.budget) for r in mixing.budgets(frame, 10, 1).collect()}
    # web 5/7 of 3015 = 2153: de is full with 50, en has the rest, src0 is full with 100
    assert got == {"src0": 100, "src1": 2153 - 50 - 100, "src2": 50, "src20": 861}


def test_mixing_of_odd_rows(spark, hostile, nothing):
    docs = spark.read.parquet(f"{hostile}/documents.parquet")
    rows = mixing.mix(docs, 300, 5).collect()
    assert all(0 <= r.taken <= r.tokens for r in rows)
    whole = [r for r in rows if r.doc_id == 8]
    assert [r.epoch for r in sorted(whole, key=lambda r: r.epoch)] == list(range(1, len(whole) + 1))
    assert op2_mixing(spark, nothing).count() == 0
    kept = mixing.keep_mixed(docs, 50)
    assert kept.columns == docs.columns and 0 < kept.count() < len(HOSTILE)
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()}
    assert mixing.keep_mixed(docs, 50).count() == kept.count()


def test_neighbours(spark, tmp_path, hostile, nothing):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    x[100:400] = x[99]  # a common vector
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = op8_ann(spark, str(tmp_path)).collect()
    x, hits = x.astype(np.float64), 0
    for q in range(0, 4000, 20):
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and q not in [r.vec_id for r in mine]
        assert all(r.score == pytest.approx(x[q] @ x[r.vec_id], abs=1e-9) for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted(((r.score, r.vec_id) for r in mine), key=lambda p: (-p[0], p[1]))
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({r.vec_id for r in mine} & set(np.lexsort((np.arange(4000), -s))[:20].tolist()))
    assert hits / 4000 >= 0.9
    odd = op8_ann(spark, hostile).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in odd if r.query_id == 40] == [(40, 1, 2), (40, 2, 1), (40, 3, 2), (40, 4, 21), (40, 5, 20)]
    assert op8_ann(spark, nothing).count() == 0
