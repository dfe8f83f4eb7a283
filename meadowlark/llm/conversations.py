"""Repair of conversations: the cheapest edits to user and assistant turns in alternation, by a checkpointed shortest path.

A conversation is right if its roles' initials read ``(s?(ua)+)?``. Rows are kept, given another role, deleted or put in;
blank and repeated rows are always deleted. A row of four costs (nothing written yet, system, user, assistant last) tells
at each place what the rest of a conversation costs. These rows run backward, are kept at checkpoints only (every
square root of a block's rows) and are made again from there while the edits are walked forward: at each place the
ASCII-least edit that is tight, that is, whose cost is all that the row of costs drops by.

Rows are sorted by range over all tasks, so a long conversation is spread over many. A conversation inside one block is
repaired where it was sorted. Of longer ones each block gives a 4 x 4 table of costs from state to state; these tables are
folded to the costs at each block's end, the blocks' ends to the states at their starts, and then every block is walked
on its own. The folds see some 150 bytes a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import stored

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: What an undeleted truncated row adds.
CUT_OFF = 3
#: ASCII white space.
BLANKS = " \t\n\x0b\f\r"
#: Rows and characters of a block at most (a longer row is a block of its own).
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 22

Costs = tuple[int, int, int, int]
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: A row's code: its initial, and 4 more if truncated, 8 more if it must go.
_INITIALS = {"s": 0, "u": 1, "a": 2}
_OTHER, _TRUNCATED, _GOES = 3, 4, 8
_KEPT = {(NOTHING, 0): SYSTEM, (NOTHING, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
#: The state after a user or assistant row, whichever may follow.
_WRITTEN = (USER, USER, ASSISTANT, USER)


def _with_inserts(v: Sequence[int]) -> Costs:
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[NOTHING], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant


#: Costs after the last row.
END: Costs = _with_inserts((0, FAR, FAR, 0))


def _least(v: Sequence[int]) -> tuple[int, Costs]:
    low = min(v)
    return low, tuple(x - low if x < FAR else FAR for x in v)  # type: ignore[return-value]


@lru_cache(1 << 16)
def _back(after: Costs, code: int) -> tuple[int, Costs]:
    """The costs before a row from those after it, less their least, which comes first."""
    raw = []
    for state in range(4):
        best = DELETE + after[state]
        if code < _GOES:
            extra = CUT_OFF if code >= _TRUNCATED else 0
            best = min(best, REROLE + extra + after[_WRITTEN[state]])
            if (kept := _KEPT.get((state, code & 3))) is not None:
                best = min(best, KEEP + extra + after[kept])
        raw.append(min(best, FAR))
    return _least(_with_inserts(raw))


@lru_cache(1 << 16)
def _tight(after: Costs, code: int, state: int) -> tuple[str, int]:
    """The ASCII-least tight edits up to and with a row's own, and the state after them."""
    low, before = _back(after, code)
    edits = ""
    while True:
        rest = before[state] + low
        if DELETE + after[state] == rest:
            return edits + "D", state
        if INSERT + before[_WRITTEN[state]] + low == rest:
            edits, state = edits + "I", _WRITTEN[state]
            continue
        extra = CUT_OFF if code >= _TRUNCATED else 0
        kept = _KEPT.get((state, code & 3))
        if kept is not None and KEEP + extra + after[kept] == rest:
            return edits + "K", kept
        return edits + "R", _WRITTEN[state]


def costs_between(codes: bytes) -> list[int]:
    """4 x 4 costs: from each state before a block (rows) to each state after it (columns)."""
    columns = []
    for end in range(4):
        total, v = 0, tuple(0 if s == end else FAR for s in range(4))
        for code in reversed(codes):
            low, v = _back(v, code)
            total += low
        columns.append([min(x + total, FAR) if x < FAR else FAR for x in v])
    return [columns[j][i] for i in range(4) for j in range(4)]


def before_block(between: Sequence[int], after: Costs) -> Costs:
    """The costs before a block from those after it."""
    return tuple(min(FAR, *(between[4 * i + j] + after[j] for j in range(4))) for i in range(4))  # type: ignore[return-value]


def walk(codes: bytes, after: Costs, state: int) -> tuple[list[str], int]:
    """Each row's edits (inserts before it among them) and the last state; ``after`` are the costs after the last row."""
    n, size = len(codes), isqrt(len(codes)) + 1
    starts = range(0, n, size)
    checkpoints, v = [], _least(after)[1]
    for start in reversed(starts):
        checkpoints.append(v)
        for i in range(min(n, start + size) - 1, start - 1, -1):
            v = _back(v, codes[i])[1]
    edits = []
    for start in starts:
        part = codes[start : start + size]
        rows = [checkpoints.pop()]
        for code in part[:0:-1]:
            rows.append(_back(rows[-1], code)[1])
        for code in part:
            found, state = _tight(rows.pop(), code, state)
            edits.append(found)
    return edits, state


def last_inserts(state: int) -> str:
    """Edits after the last row."""
    return {SYSTEM: "II", USER: "I"}.get(state, "")


def written(roles: Sequence[str], texts: Sequence[str], edits: Sequence[str], state: int) -> list[tuple[str, str]]:
    """(role, text) of the rows that edits leave; ``state`` is that before the first."""
    lines = []
    for role, text, found in zip([*roles, None], [*texts, None], [*edits, ""] if len(edits) == len(roles) else edits, strict=True):
        for edit in found:
            if edit == "D":
                continue
            if edit == "K":
                lines.append((role, text))
                state = _KEPT[state, _INITIALS[role[:1]]]
            else:
                state = _WRITTEN[state]
                lines.append(("user" if state == USER else "assistant", text if edit == "R" else ""))
    return lines


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, live): rows damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays, not live), 1 empties its text, 2 takes [.!?] from it, 3 repeats it, 4 makes it the user's.
    A null id or turn counts as one space there, and a null role or text is one space.
    """
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in (conv_id, "", turn)))
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("how"))
    how = F.col("how")
    changed = F.when(how == 1, "").when(how == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(how != 0, F.when(how == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("live"))


def _rank(turn: Column) -> Column:
    """Turns in order, null first."""
    return F.struct(turn.isNotNull().alias("known"), turn.alias("turn"))


def _marked(rows: DataFrame) -> DataFrame:
    """Adds blank, truncated and later: whether role and text stand at an earlier turn, too.

    Only keys that stand at several turns meet the rows; copies at one turn are told apart where rows are sorted.
    """
    rows = rows.withColumn("_end", F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))).withColumns({"blank": F.col("_end") == "", "truncated": ~F.col("_end").isin(".", "!", "?"), "_sha": F.sha2("text", 256)}).drop("_end")
    keys = rows.where("live and not blank").groupBy("conv_id", "role", "_sha").agg(F.min(_rank(F.col("turn"))).alias("_first"), F.max(_rank(F.col("turn"))).alias("_last")).where("_first <> _last")
    side = keys.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_sha").alias("_s"), "_first")
    joined = rows.join(side, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("_sha") == F.col("_s")), "left")
    later = F.coalesce(_rank(F.col("turn")) > F.col("_first"), F.lit(False))
    return joined.select("conv_id", "turn", "role", "text", "live", "blank", "truncated", later.alias("later"))


class _Block:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv: object):
        self.conv, self.codes, self.roles, self.texts = conv, bytearray(), [], []
        self.low = self.high = None
        self.counts = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        initial = role[:1]
        if self.roles and self.roles[-1][:1] + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        if turn is not None and turn != self.high:
            self.counts["turns"] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
        if fault:
            self.counts[fault] += 1
        self.codes.append(_INITIALS.get(initial, _OTHER) + {None: 0, "truncated": _TRUNCATED}.get(fault, _GOES))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)


_COUNTS = "turns long, blank long, duplicate long, truncated long, illegal long, low long, high long"
_LINES = "lines array<struct<role:string,text:string>>"


def _row(block: _Block, part: int, seq: int, whole: bool) -> dict:
    codes = bytes(block.codes)
    row = {"conv_id": block.conv, "part": part, "seq": seq, "low": block.low, "high": block.high, "whole": whole} | block.counts
    row |= dict.fromkeys(("cost", "audit", "lines", "codes", "between", "first_initial", "last_initial", "roles", "texts"))
    if whole:
        edits, state = walk(codes, END, NOTHING)
        edits.append(last_inserts(state))
        lines = written(block.roles, block.texts, edits, NOTHING)
        audit = "".join(edits)
        left = [code for code, edit in zip(codes, edits, strict=False) if edit[-1] != "D"]
        cost = DELETE * audit.count("D") + INSERT * audit.count("I") + REROLE * audit.count("R") + CUT_OFF * sum(code >= _TRUNCATED for code in left)
        return row | {"cost": cost, "audit": audit, "lines": [{"role": r, "text": t} for r, t in lines]}
    ends = {"first_initial": block.roles[0][:1], "last_initial": block.roles[-1][:1]} if block.roles else {}
    return row | ends | {"codes": codes, "between": costs_between(codes), "roles": block.roles, "texts": block.texts}


def _cut(schema: pa.Schema, block_rows: int, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ready = TaskContext.get().partitionId(), 0, []
        block, before, first, broken = None, None, True, False  # first: of the task's first conversation; broken: cut inside one

        def close(whole: bool) -> None:
            nonlocal seq
            ready.append(_row(block, part, seq, whole))
            seq += 1

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for r in batch.slice(at, 512).to_pylist():
                    if block is None or block.conv != r["conv_id"]:
                        if block is not None:  # the task's first and last conversation may go on in other tasks
                            close(not first and not broken)
                            first = False
                        block, before, broken = _Block(r["conv_id"]), None, False
                    elif len(block.codes) >= block_rows or block.chars >= block_chars:
                        close(False)
                        block, broken = _Block(r["conv_id"]), True
                    if r["live"]:
                        now = (r["turn"], r["role"], r["text"])
                        block.add(*now, r["blank"], r["later"] or now == before, r["truncated"])
                        before = now
                if ready:
                    yield pa.RecordBatch.from_pylist(ready, schema)
                    ready = []
        if block is not None:
            close(False)
            yield pa.RecordBatch.from_pylist(ready, schema)

    return run


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _schema(df: DataFrame, columns: str) -> StructType:
    """conv_id as it is, then the named columns."""
    return StructType([StructField("conv_id", df.schema["conv_id"].dataType), *StructType.fromDDL(columns)])


def _fold_costs(table: pa.Table) -> pa.Table:
    """Of one conversation's blocks, in order: the costs at each one's end; the sums go with the first."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    v, ends = END, []
    for r in reversed(rows):
        ends.append(list(v))
        v = before_block(r["between"], v)
    sums = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal")} | {"cost": v[NOTHING]}
    turns, low, high, last = 0, None, None, None
    for r in rows:
        if r["low"] is not None:
            turns += r["turns"] - (high == r["low"])
            low, high = r["low"] if low is None else low, r["high"]
        if r["first_initial"] is not None:
            if last is not None and last + r["first_initial"] not in ("su", "ua", "au"):
                sums["illegal"] += 1
            last = r["last_initial"]
    sums["gaps"] = high - low + 1 - turns if low is not None else 0
    nothing = dict.fromkeys(sums)
    out = [{"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "piece": i, "pieces": len(rows), "after": ends[len(rows) - 1 - i]} | (nothing if i else sums) for i, r in enumerate(rows)]
    return pa.Table.from_pylist(out, pa.schema([table.schema.field("conv_id"), *_FOLDED]))


_FOLDED = [pa.field(n, t) for n, t in (("part", pa.int32()), ("seq", pa.int32()), ("piece", pa.int32()), ("pieces", pa.int32()), ("after", pa.list_(pa.int64())), *((k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")))]
_FOLDED_DDL = "part int, seq int, piece int, pieces int, after array<long>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a block's codes by the state at its end for each state at its start."""
    for batch in batches:
        states = [[walk(c, tuple(v), s)[1] for s in range(4)] for c, v in zip(batch["codes"].to_pylist(), batch["after"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch[c] for c in ("conv_id", "part", "seq", "piece")] + [pa.array(states, pa.list_(pa.int32()))], ["conv_id", "part", "seq", "piece", "ends"])


def _fold_states(table: pa.Table) -> pa.Table:
    state, out = NOTHING, []
    for r in sorted(table.to_pylist(), key=lambda r: r["piece"]):
        out.append({"part": r["part"], "seq": r["seq"], "state": state})
        state = r["ends"][state]
    return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("state", pa.int32())]))


def _walked(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                edits, state = walk(r["codes"], tuple(r["after"]), r["state"])
                edits.append(last_inserts(state) if r["piece"] == r["pieces"] - 1 else "")
                lines = [{"role": a, "text": t} for a, t in written(r["roles"], r["texts"], edits, r["state"])]
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in schema.names if c in r} | {"audit": "".join(edits), "lines": lines}], schema)

    return run


def _joined_audits(schema: pa.Schema):
    """Sorted pieces of audits, streamed into one row a conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, audit = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["piece"] == 0:
                    if head:
                        yield pa.RecordBatch.from_pylist([head | {"audit": "".join(audit)}], schema)
                    head, audit = {c: r[c] for c in schema.names}, []
                audit.append(r["audit"])
        if head:
            yield pa.RecordBatch.from_pylist([head | {"audit": "".join(audit)}], schema)

    return run


class Repaired(NamedTuple):
    """``summary``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, a row for each conversation.
    ``turns``: conv_id, piece (from 0), pieces, lines (role and text of the rows after repair, in order)."""

    summary: DataFrame
    turns: DataFrame


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> Repaired:
    """Repairs conversations given as (conv_id, turn, role, text, live), see ``damage``.

    Rows go by turn, null turns first, then by role and text. A conversation of null id is one of its own; one without
    live rows has zeros, an empty audit and one piece without lines; without any rows there is no conversation. Roles
    other than those that start with s, u or a can't be kept. Repeated rows are duplicates of the first one.
    """
    marked = _marked(rows)
    order = ("conv_id", "turn", "role", "text")
    dealt = marked.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*order)
    schema = _schema(rows, f"part int, seq int, whole boolean, {_COUNTS}, cost long, audit string, {_LINES}, codes binary, between array<long>, first_initial string, last_initial string, roles array<string>, texts array<string>")
    blocks = stored(dealt.mapInArrow(_cut(_arrow(schema), block_rows, block_chars), schema))

    whole = blocks.where("whole")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    done = whole.select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    parts = blocks.where("not whole")
    folded = parts.select("conv_id", "part", "seq", "turns", "blank", "duplicate", "truncated", "illegal", "low", "high", "between", "first_initial", "last_initial").groupBy("conv_id").applyInArrow(_fold_costs, _schema(rows, _FOLDED_DDL))
    folded = stored(folded)
    coded = folded.select("conv_id", "part", "seq", "piece", "after").join(parts.select("part", "seq", "codes"), ["part", "seq"]).select("conv_id", "part", "seq", "piece", "after", "codes")
    states = coded.mapInArrow(_ends_of, _schema(rows, "part int, seq int, piece int, ends array<int>")).groupBy("conv_id").applyInArrow(_fold_states, "part int, seq int, state int")
    pieces_schema = _schema(rows, f"piece int, pieces int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, {_LINES}")
    walked = stored(folded.join(states, ["part", "seq"]).join(parts.select("part", "seq", "codes", "roles", "texts"), ["part", "seq"]).mapInArrow(_walked(_arrow(pieces_schema)), pieces_schema))
    summary_schema = _schema(rows, _SUMMARY)
    narrow = walked.drop("lines", "pieces").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    long = narrow.mapInArrow(_joined_audits(_arrow(summary_schema)), summary_schema)
    turns = whole.select("conv_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), "lines").unionByName(walked.select("conv_id", "piece", "pieces", "lines"))
    return Repaired(done.unionByName(long), turns)


def _hashed(schema: pa.Schema):
    """sha256 of sorted pieces, streamed: a task holds one batch of them, however long a conversation is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hasher, empty = None, None, True

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": hasher.hexdigest()}], schema)

        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if r["piece"] == 0:
                    if hasher:
                        yield row()
                    conv, hasher, empty = r["conv_id"], hashlib.sha256(), True
                for line in r["lines"]:
                    hasher.update(f"{'' if empty else chr(10)}{line['role']}:{line['text']}".encode())
                    empty = False
        if hasher:
            yield row()

    return run


def repaired_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines, joined by newlines.

    Conversations of one piece are hashed where they are. A hash is one chain over its bytes, so the pieces of a long
    conversation run through one task, sorted, a batch at a time.
    """
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    short = turns.where("pieces = 1").select("conv_id", F.sha2(text, 256).alias("repaired_sha256"))
    schema = _schema(turns, "repaired_sha256 string")
    long = turns.where("pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_hashed(_arrow(schema)), schema)
    return short.unionByName(long)
