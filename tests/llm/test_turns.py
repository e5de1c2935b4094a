"""Operator 12 against a search over all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from feedforge.llm import oracles, turns
from feedforge.llm import queries as registered
from tests.compare import database, same
from tests.llm.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string, kind string, at long"
GOOD = re.compile(r"(s?(ua)+)?")
COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        pick = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", space(text))}.get(pick, space(text))
        out += [(conv, turn, "user" if pick == 4 else space(role), text)] * {0: 0, 3: 2}.get(pick, 1)
    return out


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def facts(rows, bad):
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    ill = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return [gaps, *(bad.count(f) for f in ("blank", "duplicate", "truncated")), ill]


def all_edits(rows, bad, inserts=1):
    """Every way, with up to so many inserted rows in each place: (cost, audit, repaired)."""
    roles = ("user", "assistant")
    gap = [list(x) for n in range(inserts + 1) for x in itertools.product(roles, repeat=n)]
    per_row = []
    for (_, _, role, text), f in zip(rows, bad):
        ways = [(2, "D", [])]
        if f not in ("blank", "duplicate"):
            more = 5 * (f == "truncated")
            ways += [(more, "K", [(role, text)])] + [(1 + more, "R", [(r, text)]) for r in roles]
        per_row.append(ways)
    best = None
    for ways in itertools.product(*per_row):
        for gaps in itertools.product(gap, repeat=len(rows) + 1):
            cost, audit, said = 0, "", []
            for k, g in enumerate(gaps):
                cost, audit, said = cost + 5 * len(g), audit + "I" * len(g), said + [(r, "") for r in g]
                if k < len(ways):
                    cost, audit, said = cost + ways[k][0], audit + ways[k][1], said + ways[k][2]
            if GOOD.fullmatch("".join(r[:1] for r, _ in said)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, said)
    return best


def cheapest(rows, bad):
    """The same over an automaton, for longer conversations; nothing is inserted, which the search above bears out."""
    go = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    ways = {"": (0, "", ())}
    for (_, _, role, text), f in zip(rows, bad):
        new = {}
        for at, (cost, audit, said) in ways.items():
            steps = [(at, 2, "D", ())]
            if f not in ("blank", "duplicate"):
                more = 5 * (f == "truncated")
                steps += [(go[at][role[:1]], more, "K", ((role, text),))] if role[:1] in go[at] else []
                steps += [(go[at][r[0]], 1 + more, "R", ((r, text),)) for r in ("user", "assistant") if r[0] in go[at]]
            for to, c, e, s in steps:
                one = (cost + c, audit + e, said + s)
                new[to] = min(new.get(to, one), one)
        ways = new
    return min(ways[k] for k in ("", "a") if k in ways)


def brute(rows, search):
    out = []
    for conv in sorted({r[0] for r in rows}, key=str):
        own = in_order(hurt([r for r in rows if r[0] == conv]))
        bad = faults(own)
        cost, audit, said = search(own, bad)
        out.append((conv, *facts(own, bad), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()))
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)
    got = turns.repair(turns.damaged(df), times=turns.F.col("times"), **kw)
    assert got.columns == COLS
    return sorted((tuple(r) for r in got.collect()), key=lambda r: str(r[0]))


def conversations(n, length, seed, roles=("user", "user", "assistant", "assistant", "system", "tool")):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", "Well.  \t", "a b c."]
    return [(c, k, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {c} {k}.") for c in range(n) for k in range(rng.randint(0, length))]


def test_equals_a_search_over_all_edits(spark):
    rows = conversations(60, 4, 1)
    assert found(spark, rows) == brute(rows, all_edits)


def test_inserting_twice_never_pays():
    rng = random.Random(2)
    for _ in range(60):
        own = in_order([(0, k, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["A.", "b", ""])) for k in range(rng.randint(0, 2))])
        assert all_edits(own, faults(own), inserts=2) == all_edits(own, faults(own), inserts=0)


@pytest.mark.parametrize("chunk", [256, 7, 1])
def test_chunks_of_long_conversations(spark, chunk):
    """One conversation has a third of all rows; the result is the same wherever it is cut."""
    rows = conversations(40, 14, 3) + [(99, k, "user" if k % 2 else "assistant", f"Turn {k}." if k % 9 else "Yes.") for k in range(150)]
    assert found(spark, rows, chunk=chunk) == brute(rows, cheapest)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (1, None, "user", "B."), (1, None, "user", "A."), (1, None, "assistant", "C."), (2, 5, "user", "same."), (2, 5, "user", "same."), (2, 5, "user", "same.")]
    rows += [(3, 1, "user", "x" * 100_000 + "."), (3, 9, "assistant", "漢字 😀?"), (4, 1, "system", "S."), (5, 1, "User", "U."), (6, 0, "s", "S."), (6, 1, "u", "U."), (6, 2, "a", "A.")]
    assert found(spark, rows) == brute(rows, cheapest)
    assert found(spark, []) == []


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "user", "U."), (1, 2, "user", "V."), (1, 3, "tool", " ")], "conv_id long, turn long, role string, text string")
    got = turns.repair(df, rows=True).collect()
    assert [tuple(r) for r in got] == [(1, 0, "system", "S.", "K"), (1, 1, "user", "U.", "K"), (1, 2, "assistant", "V.", "R")]
    empty = spark.createDataFrame([(1, 0, "", "E."), (1, 1, "user", "U."), (1, 2, "assistant", "A.")], "conv_id long, turn long, role string, text string")
    assert turns.repair(empty).first()["audit"] == "KKK"


def test_query(spark):
    got = registered.queries()["op12_conversation_repair"](spark, SMALL).toPandas()
    same(got, database(SMALL).sql(oracles.oracle_sql()["op12_conversation_repair"]).df())
