"""Conversation repair against all edits, its SQL, blocks of any size, and awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from meadowlark.llm import conversations
from meadowlark.llm import queries as llm_queries

from ..compare import duck, same

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged_by_hand(rows):
    out = {}
    for conv, turn, role, text in rows:
        live = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(how, text)
        live += [(turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def faults_by_hand(rows):
    seen, out = set(), []
    for _, role, text in rows:
        left = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Of all edits that give a right conversation, the cheapest and then the ASCII-least: (cost, audit, lines)."""

    def into(table, key, value):
        if key not in table or value < table[key]:
            table[key] = value

    def follows(last, new):
        return new in {"": "su", "s": "u", "u": "a", "a": "u"}[last]

    states = {"": (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(3):  # inserts
            for last, (cost, audit, lines) in list(states.items()):
                for role in ("user", "assistant"):
                    if follows(last, role[0]):
                        into(states, role[0], (cost + 3, audit + "I", (*lines, f"{role}:")))
        if i == len(rows):
            break
        (_, role, text), fault, after = rows[i], faults[i], {}
        for last, (cost, audit, lines) in states.items():
            into(after, last, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role[:1] in ("s", "u", "a") and follows(last, role[0]):
                into(after, role[0], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
            for other in ("user", "assistant"):
                if follows(last, other[0]):
                    into(after, other[0], (cost + 3 + more, audit + "R", (*lines, f"{other}:{text}")))
        states = after
    return min(states[s] for s in ("", "a") if s in states)


def by_hand(rows):
    out = []
    for conv, live in damaged_by_hand(rows).items():
        faults = faults_by_hand(live)
        turns = [t for t, *_ in live if t is not None]
        cost, audit, lines = cheapest(live, faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(live))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def by_spark(df, **sizes):
    repaired = conversations.repair(conversations.damage(df), **sizes)
    hashes = {r.conv_id: r.repaired_sha256 for r in conversations.repaired_hashes(repaired.turns).collect()}
    return sorted((tuple(r) + (hashes[r.conv_id],) for r in repaired.summary.collect()), key=repr)


def rows_at_random(n, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \t\n", "Why? ", "So\x0b", None, "Long " * 30, "é!", "a "]
    roles = ["system", "user", "assistant", "tool", "", None, "USER", "unknown"]
    return [(rng.choice([1, 2, 3, None, 4, 4, 4, 4]), rng.choice([None, *range(60), -5]), rng.choice(roles[:3] + roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 1}, {"block_rows": 7}, {"block_chars": 40}])
def test_repair_is_the_cheapest_of_all_edits(spark, sizes):
    rows = rows_at_random(500, 5)
    assert by_spark(spark.createDataFrame(rows, SCHEMA), **sizes) == by_hand(rows)


def test_repair_equals_sql(spark):
    same(llm_queries.queries()["op13_conversation_repair"](spark, FOLDER), duck(FOLDER), llm_queries.oracle_sql()["op13_conversation_repair"])


def test_long_conversation_is_spread_over_tasks(spark):
    rows = [(7, t, ("user", "assistant")[t % 2 if t % 11 else 0], f"Turn {t // 3}." if t % 5 else "cut") for t in range(6000)] + [(8, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert by_spark(df, block_rows=512) == by_hand(rows)
    repaired = conversations.repair(conversations.damage(df), block_rows=512)
    assert repaired.turns.where("conv_id = 7").groupBy("pieces").count().count() == 1 and repaired.turns.where("conv_id = 7").count() >= 10


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 15, 16, 17, 100])
def test_checkpoints_lose_nothing(n):
    rng = random.Random(n)
    codes = bytes(rng.randrange(12) for _ in range(n))
    edits, state = conversations.walk(codes, conversations.END, 0)
    total = conversations.before_block(conversations.costs_between(codes), conversations.END)[0]
    audit = "".join(edits) + conversations.last_inserts(state)
    left = [c for c, e in zip(codes, edits, strict=True) if e[-1] != "D"]
    assert total == 4 * audit.count("D") + 3 * audit.count("I") + 3 * audit.count("R") + 3 * sum(4 <= c < 8 for c in left)
    assert all(e[-1] == "D" for c, e in zip(codes, edits, strict=True) if c >= 8)


def test_repair_of_awkward_rows(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, dropped, "user", "All dropped."), (None, None, None, None), (6, 1, "user", "Same."), (6, 1, "user", "Same."), (6, 1, "user", "Same."), (6, None, "system", "x" * 300_000)]
    clash = {c: F.lit(1) for c in ("live", "how", "blank", "later", "part", "seq", "piece", "codes", "audit", "lines", "cost", "_sha", "_first")}
    found = by_spark(spark.createDataFrame(rows, SCHEMA).withColumns(clash))
    assert found == by_hand(rows)
    assert (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in found


def test_repair_of_an_empty_table(spark):
    assert by_spark(spark.createDataFrame([], SCHEMA)) == []
