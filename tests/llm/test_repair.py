"""Repairs against every sequence of edits, and the query against a plain loop."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from llm_rows import SF, hostile, nothing  # noqa: F401

from basketlab.llm import repair

_FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def least(rows):
    """(cost, audit) by trying all edits, up to two insertions at each place.
    rows: (initial, must go, truncated)."""
    best = None
    places = ["", "u", "ua", "a", "au"]
    options = []
    for initial, gone, cut in rows:
        kinds = [("D", "", 3)]
        if not gone:
            kinds += [("K", initial, cut), ("R", "u", 2 + cut), ("R", "a", 2 + cut)]
        options += [[("I" * len(p), p, 2 * len(p)) for p in places], kinds]
    options.append([("I" * len(p), p, 2 * len(p)) for p in places])
    for way in itertools.product(*options):
        if re.fullmatch("(s?(ua)+)?", "".join(w[1] for w in way)):
            value = sum(w[2] for w in way), "".join(w[0] for w in way)
            best = min(best or value, value)
    return best


def steps(rows):
    return [repair.edits(*r) for r in rows]


@pytest.mark.parametrize("seed", range(25))
def test_agenda_equals_all_edits(seed):
    draw = random.Random(seed)
    rows = [(draw.choice("ssuuaat "), draw.random() < 0.2, draw.random() < 0.3) for _ in range(draw.randint(0, 3))]
    assert repair.agenda(steps(rows), repair.START, True) == least(rows)


def plain(rows):
    """(cost, audit) over prefixes, row after row, without an agenda."""
    best = {repair.START: (0, "")}

    def insert():
        for _ in range(2):
            for q, (c, a) in list(best.items()):
                n = repair.NEXT[q]
                best[n] = min(best.get(n, (c + 2, a + "I")), (c + 2, a + "I"))

    insert()
    for row in steps(rows):
        new = {}
        for c, a, moves in row:
            for p, q in moves.items():
                if p in best:
                    v = best[p][0] + c, best[p][1] + a
                    new[q] = min(new.get(q, v), v)
        best = new
        insert()
    return min(best[q] for q in repair.ENDS if q in best)


@pytest.mark.parametrize("seed", range(20))
def test_segments_join_to_the_whole(seed):
    draw = random.Random(seed)
    rows = [(draw.choice("suuuaaa"), draw.random() < 0.1, draw.random() < 0.2) for _ in range(60)]
    size = draw.choice([1, 7, 20])
    parts = [repair.segments(steps(rows[i : i + size])) for i in range(0, 60, size)]
    joined = [[(c, a, {p: q}) for p, q, c, a in part] for part in parts]
    assert repair.agenda(joined, repair.START, True) == repair.agenda(steps(rows), repair.START, True) == plain(rows)


def expected(chats):
    """The query's rows from (conv_id, turn, role, text), by loops."""
    out = {}
    for conv in {c[0] for c in chats}:
        rows = []
        for _, turn, role, text in (c for c in chats if c[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            name = ":".join(" " if x is None else str(x) for x in (conv, turn))
            fault = zlib.crc32(name.encode()) % 20
            if fault == 0:
                continue
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            rows += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        counts, seen, marked = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = plain(marked)
        turns = [r[0] for r in rows if r[0] is not None]
        made, at = [], 0
        for edit in audit:
            expect = "assistant" if made and made[-1][0][:1] == "u" else "user"
            if edit == "I":
                made.append((expect, ""))
                continue
            if edit != "D":
                made.append((rows[at][1] if edit == "K" else expect, rows[at][2]))
            at += 1
        assert at == len(rows)
        out[conv] = counts | {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            "illegal": sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked)),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        }
    return out


def check(spark, folder):
    chats = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: {f: r[f] for f in _FIELDS} for r in repair.op13_repair(spark, folder).collect()}
    assert found == expected(chats)
    return found


def test_given_conversations(spark):
    assert check(spark, SF)


def test_odd_conversations(spark, hostile, nothing):
    assert None in check(spark, hostile)
    assert check(spark, nothing) == {}


def test_long_conversation_in_blocks(spark, tmp_path, monkeypatch):
    """One conversation holds most rows and spreads over blocks, rounds and tasks."""
    monkeypatch.setattr(repair, "BLOCK_BITS", 3)
    monkeypatch.setattr(repair, "FAN_BITS", 2)
    draw = random.Random(5)
    rows = [(1, i // 2, draw.choice(["system", "user", "assistant", "tool", ""]), draw.choice(["Yes.", "no", "", f"{i}!", f"{i}"])) for i in range(900)]
    rows += [(c, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for c in range(2, 30) for i in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    check(spark, str(tmp_path))


def test_repaired_turns_follow_the_rule(spark):
    chats = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns, solved = repair.repair(repair.damaged(chats))
    found = {}
    for r in sorted(repair.repaired(turns, solved).collect(), key=lambda r: (r.conv_id, r.position)):
        found.setdefault(r.conv_id, []).append((r.role, r.text))
    sums = {r.conv_id: r.repaired_sha256 for r in repair.summaries(turns, solved, turns.select("conv_id").distinct()).collect()}
    for conv, made in found.items():
        assert re.fullmatch("s?(ua)+", "".join(role[0] for role, _ in made))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest() == sums[conv]
