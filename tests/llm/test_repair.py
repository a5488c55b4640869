"""Repairs against all edits of small conversations, and against a row-by-row DP on long ones."""

import hashlib
import random
import zlib
from functools import cache
from itertools import groupby

import numpy as np
import pytest

from maskwright.llm import repair

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    """(conversation, rows after damage in order)."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (1 + (k == 3))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def step(state, initial):
    """State after a role's initial in the order s?(ua)+, or None."""
    return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, initial))


def expected(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        shown = text.strip(SPACE)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {(len(rows), 0): (0, "", ()), (len(rows), 3): (0, "", ()), (len(rows), 2): (2, "I", ("assistant:",)), (len(rows), 1): (4, "II", ("user:", "assistant:"))}
    for i in reversed(range(len(rows))):
        _, role, text = rows[i]
        must, extra = faults[i] in ("blank", "duplicate"), faults[i] == "truncated"
        base = {}
        for q in range(4):
            name = "assistant" if q == 2 else "user"
            ways = [(3, "D", (), q)]
            if not must:
                ways.append((2 + extra, "R", (f"{name}:{text}",), step(q, name[0])))
                if step(q, role[:1]) is not None:
                    ways.append((extra, "K", (f"{role}:{text}",), step(q, role[:1])))
            base[q] = min((paid + best[i + 1, to][0], letter + best[i + 1, to][1], line + best[i + 1, to][2]) for paid, letter, line, to in ways)
        for _ in range(2):  # insertions before the row
            for q in (2, 3, 0, 1):
                name = "assistant" if q == 2 else "user"
                c, a, t = base[step(q, name[0])]
                base[q] = min(base[q], (c + 2, "I" + a, (f"{name}:", *t)))
        best |= {(i, q): v for q, v in base.items()}
    cost, audit, lines = best[0, 0]
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines,
    )


def conversations(rng, many, longest):
    rows = []
    for conv in range(many):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"])
            text = rng.choice([f"Text {rng.randint(0, 40)}.", "same.", "no end", "", " \n", None, "é? ", "中文"])
            rows.append((None if conv == 3 else conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 2]), role, text))
    return rows


@pytest.mark.parametrize("held, gathered", [(repair.HELD_CHARS, repair.GATHERED), (300, 5)])
def test_against_row_by_row(spark, monkeypatch, held, gathered):
    monkeypatch.setattr(repair, "HELD_CHARS", held)
    monkeypatch.setattr(repair, "GATHERED", gathered)
    rows = conversations(random.Random(6), 120, 14)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, idx long").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damaged(table)).collect()}
    want = {c: expected(v) for c, v in damage(rows).items()}
    assert got == {c: v[:-1] for c, v in want.items()}
    lines = {}
    for r in repair.repaired_rows(repair.damaged(table)).collect():
        lines.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    assert {c: tuple(t for _, t in sorted(v)) for c, v in lines.items()} == {c: v[-1] for c, v in want.items() if v[-1]}


def test_a_conversation_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "HELD_CHARS", 2000)
    rng = random.Random(2)
    rows = conversations(rng, 90, 14) + [(1000, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["same.", f"own {t}.", f"cut {t}"])) for t in range(700)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {c: expected(v)[:-1] for c, v in damage(rows).items()}


def test_least_audit_among_all_edits():
    """Every way to edit up to four rows, tried out; ties by the audit."""

    @cache
    def ways(rows, state, inserted=0):
        out = [(0, "")] if not rows and state in (0, 3) else []
        if rows:
            (role, must, extra), rest = rows[0], rows[1:]
            out += [(3 + c, "D" + a) for c, a in ways(rest, state)]
            if not must:
                out += [(extra + c, "K" + a) for c, a in (ways(rest, step(state, role)) if step(state, role) is not None else ())]
                out += [(2 + extra + c, "R" + a) for name in "ua" if step(state, name) is not None for c, a in ways(rest, step(state, name))]
        if inserted < 2:  # more in a row are never needed
            out += [(2 + c, "I" + a) for name in "ua" if step(state, name) is not None for c, a in ways(rows, step(state, name), inserted + 1)]
        return out

    rng = random.Random(3)
    cases = [tuple((rng.choice("usat"), rng.random() < 0.2, rng.randint(0, 1)) for _ in range(rng.randint(0, 4))) for _ in range(300)]
    code = np.array([repair.CODES.get(r[0], 0) for c in cases for r in c], int)
    forced, cut = np.array([r[1] for c in cases for r in c], bool), np.array([r[2] and not r[1] for c in cases for r in c], bool)
    first = np.concatenate([[0], np.cumsum([len(c) for c in cases])])
    n = len(cases)
    cost, audits, after = repair.least_repairs(first, code, forced, cut, np.tile(repair.FINAL, (n, 1)), np.ones(n, bool), np.zeros(n, int))
    assert [*zip(cost.tolist(), audits)] == [min(ways(c, 0)) for c in cases]
    assert set(after.tolist()) <= {0, 3}


def test_ranks_order_audits():
    """Doubled pointers walk a path of any length letter by letter."""
    code = np.array([2, 3] * 37 + [0, 1, 2])
    n = len(code)
    free = np.zeros(n, bool)
    _, (audit,), _ = repair.least_repairs(np.array([0, n]), code, free, free, repair.FINAL[None, :], np.ones(1, bool), np.zeros(1, int))
    assert audit == expected([(k, "?sua"[c] if c else "tool", f"{k}.") for k, c in enumerate(code)])[6]
    assert [len([*g]) for k, g in groupby(audit)][0] == 74


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(repair.damaged(empty)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello."), (None, None, None, None)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damaged(spark.createDataFrame(rows, empty.schema))).collect()}
    assert got == {c: expected(v)[:-1] for c, v in damage(rows).items()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    long = [(1, 0, "user", "x" * 5_000_000), (1, 1, "assistant", "y."), (2, 0, "user", "z.")]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damaged(spark.createDataFrame(long, empty.schema))).collect()}
    assert got == {c: expected(v)[:-1] for c, v in damage(long).items()}
