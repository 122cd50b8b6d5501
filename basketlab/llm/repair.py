"""Conversation structure repair by Knuth's lightest derivation (operator 13).

A conversation should read: perhaps a system turn, then pairs of user and assistant, or
nothing. Each row is kept (cost 0), given the role of user or assistant (2) or deleted
(3; a must for blank and duplicate rows); empty turns of either role may be inserted
(2); a truncated row that stays adds 1. The cheapest way wins, and of equally cheap ones
the one whose audit (the edits' initials in order, D I K R) is least.

Items of the deduction are "a row may be edited so" (axioms) and "the rows before i are
repaired and end in state q". A hyperedge joins a prefix and an edit of its next row to
the longer prefix; inserting is a deduction from a prefix alone. An agenda pops the
item with the least (cost, audit), which is then final, since costs add up, audits grow
at the end, and of two ways to one item with equal cost neither audit begins the other
(each further insertion costs 2), so that every deduction is monotone and superior.

Scale: rows are dealt by ranges of (conversation, turn, role, beginning of the text), so
a conversation of any length spreads over tasks. Repeated rows are found by a combined
minimum per hashed row, not by a window. Agendas run on blocks of at most `BLOCK` rows,
which give the lightest value from each state to each state; these segments are edges
of a second agenda, in rounds of `FAN` blocks, until one is left. The repaired turns are
replayed as a stream, so a task holds one audit and one Arrow batch, not a conversation;
only that stream is sequential per conversation, as a hash of it must be.

Defined cases: null roles and texts are one space, as are null ids and turns in the hash
that draws the damage; rows of a null conversation id form one conversation; null turns
come first; rows of one turn are ordered by role, then text; a role without a first
letter (empty) can't be kept; a conversation without rows has zeros, an empty audit and
the hash of the empty string; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.pandas.types import to_arrow_schema

from basketlab.llm import common
from basketlab.sources.scratch import materialize

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLOCK_BITS = 9  # rows of a block: 512
FAN_BITS = 6  # blocks combined at once: 64
_BLANKS = " \t\n\x0b\x0c\r"

# states: what the repaired turns before end with
START, SYSTEM, USER, ASSISTANT = range(4)
#: the state after a user or assistant turn, whichever must come next
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
SAME = {q: q for q in NEXT}
#: of a row that keeps its role, by the role's initial
KEEP = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
ENDS = (START, ASSISTANT)
_SLOTS = 64  # items of one position: 4 prefixes, then its edits or segments
_GOAL = -1

Value = tuple[int, str]
Step = tuple[int, str, dict[int, int]]  # cost, audit, state after by state before


def agenda(steps: list[list[Step]], start: int, goal: bool):
    """Lightest (cost, audit) over one step per position with insertions between.

    With `goal` that of the whole, the agenda stopping there; else by end state.
    """
    n = len(steps)
    heap = [(cost, audit, _SLOTS * i + 4 + j) for i, row in enumerate(steps) for j, (cost, audit, _) in enumerate(row)]
    heap.append((0, "", start))
    heapify(heap)
    chart: dict[int, Value] = {}
    while heap:
        cost, audit, item = heappop(heap)
        if item in chart:
            continue
        if item == _GOAL:
            return cost, audit
        chart[item] = cost, audit
        i, slot = divmod(item, _SLOTS)
        made = []
        if slot < 4:
            made.append((cost + INSERT, audit + "I", _SLOTS * i + NEXT[slot]))
            if i < n:
                for j, (c, a, moves) in enumerate(steps[i]):
                    if slot in moves and _SLOTS * i + 4 + j in chart:
                        made.append((cost + c, audit + a, _SLOTS * (i + 1) + moves[slot]))
            elif goal and slot in ENDS:
                made.append((cost, audit, _GOAL))
        else:
            for before, after in steps[i][slot - 4][2].items():
                if (prefix := chart.get(_SLOTS * i + before)) is not None:
                    made.append((prefix[0] + cost, prefix[1] + audit, _SLOTS * (i + 1) + after))
        for value in made:
            if value[2] not in chart:
                heappush(heap, value)
    return {q: chart[_SLOTS * n + q] for q in NEXT if _SLOTS * n + q in chart}


def edits(initial: str, must_go: bool, truncated: bool) -> list[Step]:
    """The axioms of one row."""
    gone = (DELETE, "D", SAME)
    if must_go:
        return [gone]
    extra = TRUNCATED * truncated
    found = [gone, (REROLE + extra, "R", NEXT)]
    if initial in KEEP:
        found.append((extra, "K", KEEP[initial]))
    return found


def segments(steps: list[list[Step]]) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a run of positions."""
    return [(p, q, cost, audit) for p in NEXT for q, (cost, audit) in agenda(steps, p, False).items()]


def damaged(chats: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of `chats` with faults drawn by crc32("conv_id:turn")."""
    space = F.lit(" ")
    name = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    rows = chats.select(
        "conv_id",
        "turn",
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20).alias("fault"),
    )
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(fault == 4, "user").otherwise(F.col("role"))
    times = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy"))
    return rows.drop("copy")


def laid(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text), written in order, with `ord`: increasing by
    conversation, turn (nulls first), role and text."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the beginning of the text parts many rows of one turn; bounds stay short
    dealt = rows.repartitionByRange(n, "conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 16))
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
    return materialize(dealt.withColumn("ord", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, ord, initial, and of blank, duplicate and truncated the first that holds."""
    bare = F.rtrim("text", F.lit(_BLANKS))
    rows = turns.select(
        "conv_id",
        "ord",
        F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256).alias("row"),
    )
    rows = materialize(rows, "rows")
    again = rows.groupBy("conv_id", "row").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("row").alias("r"), "first")
    met = rows.join(again, rows.conv_id.eqNullSafe(again.c) & (rows.row == again.r), "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("ord") > F.col("first"), F.lit(False))
    return met.withColumn("duplicate", duplicate).select(
        "conv_id", "ord", "initial", "blank", "duplicate", (~F.col("blank") & ~F.col("duplicate") & F.col("cut")).alias("truncated")
    )


def _mapped(df: DataFrame, schema: str, work) -> DataFrame:
    """One row (a dict) made of each row."""
    common.ship(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, common.SLICE_ROWS):
                made = [work(row) for row in batch.slice(at, common.SLICE_ROWS).to_pylist()]
                yield pa.RecordBatch.from_pylist(made, schema=target)

    return df.mapInArrow(run, schema)


_COUNTS = ("blank", "duplicate", "truncated")
_SEGMENTS = "conv_id {}, block long, blank long, duplicate long, truncated long, segments array<struct<before:int,after:int,cost:long,audit:string>>"


def _solved(row: dict) -> dict:
    steps = [edits(r["initial"], r["gone"], r["truncated"]) for r in row.pop("rows")]
    return row | {"segments": [dict(zip(("before", "after", "cost", "audit"), s)) for s in segments(steps)]}


def _steps(blocks: list[dict]) -> list[list[Step]]:
    return [[(s["cost"], s["audit"], {s["before"]: s["after"]}) for s in b["segments"]] for b in blocks]


def _joined(row: dict) -> dict:
    found = segments(_steps(row.pop("blocks")))
    return row | {"segments": [dict(zip(("before", "after", "cost", "audit"), s)) for s in found]}


def _goal(row: dict) -> dict:
    cost, audit = agenda(_steps(row.pop("blocks")), START, True)
    return row | {"cost": cost, "audit": audit}


def audits(faulty: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated (rows), cost, audit of every conversation
    that has rows. `faulty` is that of `faults`."""
    kind = dict(faulty.dtypes)["conv_id"]
    row = F.struct("ord", "initial", (F.col("blank") | F.col("duplicate")).alias("gone"), "truncated")
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in _COUNTS]
    blocks = faulty.groupBy("conv_id", F.shiftright("ord", BLOCK_BITS).alias("block")).agg(*sums, F.array_sort(F.collect_list(row)).alias("rows"))
    solved = materialize(_mapped(blocks, _SEGMENTS.format(kind), _solved), "segments")
    listed = F.array_sort(F.collect_list(F.struct("block", "segments"))).alias("blocks")
    while True:
        most = solved.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1 << FAN_BITS:
            break
        groups = solved.groupBy("conv_id", F.shiftright("block", FAN_BITS).alias("block")).agg(*sums, listed)
        solved = materialize(_mapped(groups, _SEGMENTS.format(kind), _joined), "segments")
    whole = solved.groupBy("conv_id").agg(*sums, listed)
    return _mapped(whole, f"conv_id {kind}, blank long, duplicate long, truncated long, cost long, audit string", _goal)


class Replay:
    """Applies an audit to a conversation's rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _new(self) -> str:
        self.state = NEXT[self.state]
        return "user" if self.state == USER else "assistant"

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._new(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """Repaired turns up to this row's."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._new(), text
        elif edit == "K":
            self.state = KEEP[role[0]][self.state]
            yield role, text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


class _Summary:
    """What a conversation's result row says, from its rows in order."""

    def __init__(self, conv_id):
        self.row = {"conv_id": conv_id, **dict.fromkeys(("gaps", *_COUNTS, "illegal", "cost"), 0), "audit": ""}
        self.replay, self.hash, self.turns = Replay(""), hashlib.sha256(), 0
        self.low = self.high = self.initial = None
        self.distinct = 0

    def solved(self, row: dict) -> None:
        self.row |= {c: row[c] for c in (*_COUNTS, "cost", "audit")}
        self.replay = Replay(row["audit"])

    def _write(self, turns) -> None:
        for role, text in turns:
            self.hash.update(f"{chr(10) * (self.turns > 0)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.turns += 1

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.row["illegal"] += 1
        self.initial = role[:1]
        self._write(self.replay.row(role, text))

    def close(self) -> dict:
        self._write(self.replay.end())
        if self.high is not None:
            self.row["gaps"] = self.high - self.low + 1 - self.distinct
        return self.row | {"repaired_sha256": self.hash.hexdigest()}


def _sorted(turns: DataFrame, solved: DataFrame, ids: DataFrame) -> DataFrame:
    """Each conversation's marker, audit and rows, in this order, within one partition."""
    rows = turns.withColumn("kind", F.lit(2)).unionByName(solved.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = rows.unionByName(ids.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "ord")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Every row, and whether it begins another conversation."""
    now: tuple = ()
    for batch in batches:
        for at in range(0, batch.num_rows, common.SLICE_ROWS):
            for row in batch.slice(at, common.SLICE_ROWS).to_pylist():
                yield now != (row["conv_id"],), row
                now = (row["conv_id"],)


def summaries(turns: DataFrame, solved: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conversation of `ids` (conv_id): counts, cost, audit and the hash of
    its repaired turns."""
    kind = dict(turns.dtypes)["conv_id"]
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    target = to_arrow_schema(_parse_datatype_string(schema))
    common.ship(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, done = None, []
        for new, row in _conversations(batches):
            if new:
                done += [open_.close()] if open_ else []
                open_ = _Summary(row["conv_id"])
                if len(done) >= common.SLICE_ROWS:
                    yield pa.RecordBatch.from_pylist(done, schema=target)
                    done = []
            if row["kind"] == 1:
                open_.solved(row)
            elif row["kind"] == 2:
                open_.add(row["turn"], row["role"], row["text"])
        done += [open_.close()] if open_ else []
        yield pa.RecordBatch.from_pylist(done, schema=target)

    return _sorted(turns, solved, ids).mapInArrow(run, schema)


def repaired(turns: DataFrame, solved: DataFrame) -> DataFrame:
    """conv_id, position (from 0), role, text of every repaired turn."""
    kind = dict(turns.dtypes)["conv_id"]
    schema = f"conv_id {kind}, position long, role string, text string"
    target = to_arrow_schema(_parse_datatype_string(schema))
    common.ship(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, conv, made, at = None, None, [], 0

        def put(found):
            nonlocal at
            for role, text in found:
                made.append({"conv_id": conv, "position": at, "role": role, "text": text})
                at += 1

        for new, row in _conversations(batches):
            if new:
                put(replay.end() if replay else ())
                conv, at = row["conv_id"], 0
            if row["kind"] == 1:
                replay = Replay(row["audit"])
            else:
                put(replay.row(row["role"], row["text"]))
            if len(made) >= common.SLICE_ROWS:
                yield pa.RecordBatch.from_pylist(made, schema=target)
                made = []
        put(replay.end() if replay else ())
        yield pa.RecordBatch.from_pylist(made, schema=target)

    return _sorted(turns, solved, turns.select("conv_id").limit(0)).mapInArrow(run, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns in order, audits) of `rows` (conv_id, turn, role, text; none of role and
    text null), for `summaries` and `repaired`."""
    turns = laid(rows)
    return turns, materialize(audits(faults(turns)), "audits")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of every conversation, after the contract's damage."""
    chats = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return summaries(*repair(damaged(chats)), chats.select("conv_id").distinct())
