"""Repair of conversations: the fold and the stream against an enumeration of all edits read literally."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from cohortry.llm.conversation_repair import damaged, repaired

SPACE = " \t\n\x0b\x0c\r"


def all_repairs(rows):
    """(cost, audit, turns) of every way to edit rows, each (role, text, must_go, truncated), with up to two inserts at each gap."""
    inserts = [w for n in range(3) for w in itertools.product(("user", "assistant"), repeat=n)]

    def ways(row):
        role, text, must_go, truncated = row
        yield 4, "D", []
        if not must_go:
            extra = 3 if truncated else 0
            yield extra, "K", [(role, text)]
            for to in ("user", "assistant"):
                yield 3 + extra, "R", [(to, text)]

    for edits in itertools.product(*(list(ways(r)) for r in rows)):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(e[0] for e in edits) + 3 * sum(map(len, gaps))
            audit, turns = "I" * len(gaps[0]), [(r, "") for r in gaps[0]]
            for e, gap in zip(edits, gaps[1:], strict=True):
                audit += e[1] + "I" * len(gap)
                turns = turns + e[2] + [(r, "") for r in gap]
            yield cost, audit, turns


@functools.cache
def literal(rows):
    """What the contract says of one conversation's rows (turn, role, text) after damage, in order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults, todo = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        todo.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    good = ((c, a, t) for c, a, t in all_repairs(todo) if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in t)) and all(r for r, _ in t))
    cost, audit, turns = min(good, key=lambda x: (x[0], x[1]))
    return gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


ROLES = ["system", "user", "assistant", "user", "assistant", None, "tool", "", "umpire"]
TEXTS = [None, "", "Hi.", "Hi", "Why? \t", "No!\n", "\x0b", "x\ny.", "é…"]


def conversations(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [(c if c else None, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(ROLES), rng.choice(TEXTS), "clash") for c in range(n) for _ in range(rng.randint(1, 3))]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, alive_not string").repartition(5)


@pytest.mark.parametrize("fold_turns", [2_000, 0, 2])
def test_repairs_are_the_cheapest_of_all(spark, fold_turns):
    table = conversations(spark)
    by: dict = {}
    for r in table.collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role or (" " if r.role is None else ""), " " if r.text is None else r.text))
    got = {r[0]: tuple(r) for r in repaired(table, fold_turns=fold_turns).drop("plan").collect()}
    assert len(got) == len(by)
    for conv, rows in by.items():
        assert got[conv][1:] == literal(tuple(rows)), rows


def hurt(conv, turn, role, text):
    """The rows that damage leaves of one, read literally."""
    code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    if code == 0:
        return []
    text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
    return [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)


def test_damage_follows_the_keys(spark):
    table = conversations(spark, 400, 2)
    want = sorted(str((r.conv_id, *x)) for r in table.collect() for x in hurt(r.conv_id, r.turn, r.role, r.text))
    rows = damaged(table)
    assert sorted(str((r.conv, r.turn, r.role, r.text)) for r in rows.filter("alive").collect()) == want
    one, two = (sorted(map(str, repaired(rows, fold_turns=n).collect())) for n in (2_000, 0))
    assert one == two and len(one) == 400
    alive = {r.conv for r in rows.filter("alive").collect()}
    bare = [r for r in repaired(rows).collect() if r.conv_id not in alive]
    assert bare and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", "", hashlib.sha256(b"").hexdigest()) for r in bare)


def test_a_long_conversation_is_streamed_with_the_same_result(spark):
    rng = random.Random(3)
    rows = [(7, k if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", f"own {k}.", f"own {k}", ""])) for k in range(3_000)]
    table = spark.createDataFrame(rows + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    one, two = ({r.conv_id: tuple(r) for r in repaired(table, fold_turns=n).collect()} for n in (10_000, 100))
    assert one == two and one[8][6:8] == (0, "KK") and len(one[7][7]) >= 3_000


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repaired(none).count() == 0 and repaired(damaged(none)).count() == 0
