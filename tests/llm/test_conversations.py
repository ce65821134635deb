"""Conversation repair against plain code: every edit script is tried on small ones, and text by text on tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railpulse.llm import conversation_repair as repair
from tests.llm.conftest import CLASHES

GOOD = re.compile(r"(s?(ua)+)?")
sys.setrecursionlimit(max(sys.getrecursionlimit(), 5000))
SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    *[T.StructField(name, T.StringType()) for name in (*CLASHES, "copies", "seen", "audit", "part", "kind")],
])
EXTRA = tuple("x" for _ in range(len(SCHEMA) - 4))


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        ending = text.rstrip(" \t\n\x0b\x0c\r")
        if not ending:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("" if ending[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def apply(rows, audit):
    """The repaired rows that an audit gives, or None."""
    out, state, rest = [], "", list(rows)
    after = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    for letter in audit:
        if letter != "I":
            _, role, text = rest.pop(0)
        if letter == "D":
            continue
        if letter == "K":
            out.append((role, text))
        else:
            out.append((after[state], "" if letter == "I" else text))
        state = out[-1][0][:1]
        if state not in after:
            return None
    return out if not rest and GOOD.fullmatch("".join(r[:1] or "?" for r, _ in out)) else None


def by_trial(rows, inserts=3):
    """The cheapest script of all that have few inserts, by trying them."""
    found, fault = [], faults(rows)
    for kinds in itertools.product("DKR", repeat=len(rows)):
        for places in itertools.product(range(inserts), repeat=len(rows) + 1):
            audit = "".join("I" * n + k for n, k in itertools.zip_longest(places, kinds, fillvalue=""))
            cost = 3 * audit.count("I")
            for k, f in zip(kinds, fault):
                cost += {"D": 4, "K": 0, "R": 3}[k] + 3 * (k != "D" and f == "truncated")
            if any(k != "D" and f in ("blank", "duplicate") for k, f in zip(kinds, fault)):
                continue
            if apply(rows, audit) is not None:
                found.append((cost, audit))
    return min(found)


def by_tuples(rows):
    """The same by comparing (cost, letters) from the end on."""
    fault = faults(rows)
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    other = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, may_insert):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []

        def way(letter, cost, then):
            if then is not None:
                ways.append((then[0] + cost, letter + then[1]))

        if may_insert:
            way("I", 3, best(i, other[state], may_insert - 1))
        if i < len(rows):
            extra = 3 * (fault[i] == "truncated")
            way("D", 4, best(i + 1, state, 2))
            if fault[i] in ("", "truncated"):
                role = rows[i][1][:1]
                if role and role in follows[state]:
                    way("K", extra, best(i + 1, role, 2))
                way("R", 3 + extra, best(i + 1, other[state], 2))
        return min(ways, default=None)

    # From the end on, so that no call goes deep.
    for i in range(len(rows), -1, -200):
        for state in ("", "s", "u", "a"):
            best(i, state, 2)
    return best(0, "", 2)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain(rows):
    """conv_id: the contract's columns."""
    found, hurt = {}, damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in hurt if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in own if r[0] is not None]
        fault = faults(own)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = by_tuples(own)
        text = "\n".join(f"{role}:{text}" for role, text in apply(own, audit))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found[conv] = (gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, cost,
                       audit, hashlib.sha256(text.encode()).hexdigest())
    return found


def outcome(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def some_rows(pick, n, roles=("system", "user", "assistant", "user", "assistant", "tool")):
    texts = ("Yes.", "No!", "cut", " \n", "a?\t", "b.", "c.", "d.", "e.", "f.")
    return [(i, pick.choice(roles), pick.choice(texts)) for i in range(n)]


def weights(rows):
    fault = faults(rows)
    found, width = repair.least_weights([repair.Row(r[1], 1, f) for r, f in zip(rows, fault)], (repair.START, repair.A))
    return repair.spelled(found[repair.START], width)


def test_all_scripts_of_small_conversations():
    pick = random.Random(3)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3, 4):
        for _ in range(6 if n < 4 else 2):
            rows = some_rows(pick, n)
            assert weights(rows) == by_tuples(rows) == by_trial(rows), rows


def test_integers_choose_as_tuples_do():
    pick = random.Random(4)
    for n in (5, 8, 13, 40, 90):
        for _ in range(12):
            rows = some_rows(pick, n)
            assert weights(rows) == by_tuples(rows), rows


def test_pieces_combine_to_the_whole():
    pick = random.Random(5)
    for n in (2, 3, 7, 20, 50):
        for _ in range(8):
            rows = some_rows(pick, n)
            marked = [repair.Row(r[1], 1, f) for r, f in zip(rows, faults(rows))]
            cuts = sorted({0, n, *(pick.randrange(n + 1) for _ in range(4))})
            pieces = [repair.paths(marked[a:b]) for a, b in zip(cuts, cuts[1:])]
            assert repair.cheapest(repair.joined_all(pieces)) == by_tuples(rows), (rows, cuts)


@pytest.fixture
def talk(spark):
    return lambda rows: spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


ODD = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 5, "assistant", "Yes."),
    (2, None, None, None), (2, None, "system", "Be kind."), (2, 4, "user", "x" * 100_000 + "."), (3, 7, "", "a."),
    (None, 1, "user", "q?"), (None, None, "tool", "r."), (4, 0, "user", ""), (4, 1, "assistant", " \t\r\n"), (5, -3, "s", "é!"),
    (6, 2, "user", "same turn."), (6, 2, "assistant", "same turn."), (6, 2, None, "same turn."), (7, 0, "usher", "\x00."),
]


def test_damaged_and_repaired(talk):
    pick = random.Random(6)
    rows = list(ODD)
    for conv in range(10, 90):
        rows += [(conv, t, r, x) for t, r, x in some_rows(pick, pick.randrange(1, 9))]
    assert outcome(repair.damaged_and_repaired(talk(rows))) == plain(rows)


def test_no_rows(talk):
    assert repair.damaged_and_repaired(talk([])).collect() == []
    assert repair.repaired_rows(talk([])).collect() == []


def test_a_conversation_in_many_partitions(talk, spark):
    """A third of all rows are one conversation: its rows are dealt over the partitions, the outcome is whole."""
    pick = random.Random(7)
    rows = [(1, t, r, x) for t, r, x in some_rows(pick, 1200)] + [(1, 3, "user", "many.")] * 50
    for conv in range(2, 400):
        rows += [(conv, t, r, x) for t, r, x in some_rows(pick, 6)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        df = talk(rows)
        per_part = repair._ordered(repair.damaged(df)).groupBy(F.spark_partition_id()).count().collect()
        assert len(per_part) == 12 and max(r["count"] for r in per_part) < 600
        assert outcome(repair.damaged_and_repaired(df)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repaired_rows(talk):
    pick = random.Random(8)
    rows = [(c, t, r, x) for c in range(30) for t, r, x in some_rows(pick, 7)]
    found = repair.repaired_rows(talk(rows)).orderBy("conv_id", "place").collect()
    for conv in range(30):
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: r[0])
        mine = [r for r in found if r.conv_id == conv]
        assert [(r.role, r.text) for r in mine] == apply(own, by_tuples(own)[1])
        assert [r.place for r in mine] == list(range(len(mine)))
        assert GOOD.fullmatch("".join(r.role[0] for r in mine))
