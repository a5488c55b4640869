"""Maximal conversations against a plain loop."""

import random

from maskwright.llm import chat


def expected(rows):
    logs = {}
    for c, t, r, x, *_ in rows:
        logs.setdefault(c, []).append((t is not None, t or 0, r if r is not None else "unknown", x or ""))
    logs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in logs.items()}
    out = {}
    for c, own in logs.items():
        inner = any(len(o) > len(own) and o[: len(own)] == own for o in logs.values())
        first = min((k for k, o in logs.items() if o == own), key=lambda k: (k is not None, k or 0))
        if not inner and first == c:
            out[c] = "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in own)
    return out


def check(spark, rows):
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int").repartition(5)
    got = chat.maximal_conversations(log).collect()
    assert {r.conv_id: r.rendered for r in got} == expected(rows) and len(got) == len(expected(rows))
    turns = {c: 0 for c in expected(rows)}
    for r in rows:
        if r[0] in turns:
            turns[r[0]] += 1
    assert all(r.n_turns == turns[r.conv_id] and r.n_chars == len(r.rendered) for r in got)


def test_random_logs(spark):
    rng = random.Random(3)
    rows, made = [], [[]]
    for c in range(150):
        own = list(rng.choice(made))[: rng.randint(0, 6)] + [(rng.choice(["user", "assistant"]), rng.choice(["hi", "yes", "no %s"])) for _ in range(rng.randint(0, 2))]
        own = own or [("user", "hi")]
        made.append(own)
        rows += [(c, t, r, x, 1) for t, (r, x) in enumerate(own)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, 0, None, None, 0), (1, 1, "user", "a", 0), (2, 0, "unknown", "", 0), (None, 0, "user", "n", 0), (None, None, "user", "m", 0), (3, None, "user", "m", 0), (4, 0, "user", "x", 0), (4, 0, "user", "x", 0), (5, 0, "user", "x", 0), (6, 7, "user", "z", 0), (7, 9, "user", "z", 0)]
    check(spark, rows)
    assert chat.maximal_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
