"""Targets, flow and selection."""

import itertools
import random
import re

import numpy as np
import pytest

from maskwright.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 100, 100]) == pytest.approx([30, 120, 60])
    assert mixing.targets([0, 5]) == pytest.approx([0, 5]) and mixing.targets([]) == []
    assert sum(mixing.targets([5, 1, 900, 40])) == pytest.approx(946)


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_feasible_full_and_cheapest(seed):
    rng = random.Random(seed)
    sources = rng.randint(1, 3)
    members = [sorted(rng.sample(range(sources), rng.randint(1, sources))) for _ in range(rng.randint(1, 4))]
    capacity = [rng.randint(0, 3) for _ in members]
    due = [rng.randint(0, 4) for _ in range(sources)]
    flow = mixing.min_cost_flow([float(c) for c in capacity], members, [float(d) for d in due])
    used = flow.sum(1)
    assert (flow >= -1e-9).all() and (used <= 3 * np.array(capacity) + 1e-6).all() and (flow.sum(0) <= np.array(due) + 1e-6).all()
    assert all(flow[p, s] < 1e-9 or s in members[p] for p in range(len(members)) for s in range(sources))
    cost = lambda u: sum(max(0, u[p] - c) + max(0, u[p] - 2 * c) for p, c in enumerate(capacity))

    def reachable(u):  # can these whole amounts be dealt out without exceeding a quota?
        states = {tuple([0] * sources)}
        for p, n in enumerate(u):
            for _ in range(n):
                states = {tuple(x + (k == s) for k, x in enumerate(g)) for g in states for s in members[p] if g[s] < due[s]}
        return bool(states)

    options = [u for u in itertools.product(*[range(3 * c + 1) for c in capacity]) if reachable(u)]
    most = max(sum(u) for u in options)
    assert used.sum() == pytest.approx(most)
    assert cost(used) == pytest.approx(min(cost(u) for u in options if sum(u) == most), abs=1e-6)


def test_documents_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix_sources(docs).collect()
    texts = {r.doc_id: (r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()}
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, (t, _) in texts.items()}
    assert all(r.size == sizes[r.doc_id] and r.taken == r.size * r.repeats and 0 <= r.repeats <= 3 for r in got) and len(got) == len(texts)
    names = sorted({s for _, s in texts.values()})
    of = [sum(sizes[i] for i, (_, s) in texts.items() if s == n) for n in names]
    due = dict(zip(names, mixing.targets(of)))
    for n, size in zip(names, of):
        own = [r for r in got if r.source == n]
        assert {(r.source_size, round(r.target, 6)) for r in own} == {(size, round(due[n], 6))}
        assert abs(due[n] - sum(r.taken for r in own)) <= 0.02 * due[n]
    again = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_hard_rows(spark):
    rows = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (2, None, None, 1), (3, "d", None, 1), (None, "e f", "é", 2), (4, " ", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 6 and all(r.taken <= 3 * r.size for r in got) and sum(r.taken for r in got) <= 3 * 9
    assert {r.target for r in got if r.source == "z"} == {0.0}
    assert mixing.mix_sources(docs.where("false")).count() == 0
    assert mixing.mixed_documents(docs).columns == ["doc_id", "text", "source", "size", "repeats"]


def test_overlapping_sources(spark):
    rows = [(k, ["a"] if k < 100 else ["a", "b"], 10) for k in range(200)]
    docs = spark.createDataFrame(rows, "row_key long, members array<string>, size int")
    got = mixing.mix_documents(docs, "members", "size", ["a", "b"], weights=(1.0, 1.0)).groupBy("members").agg({"repeats": "sum"}).collect()
    # shared documents count in both sources: 3,000 words are due of the 2,000 that there are
    assert sum(r[1] for r in got) * 10 == pytest.approx(3000, abs=20)


def plain_mix(rows, due):
    """Repeats of every row (source, size, spot, key) by going through the seeded order again and again."""
    out = {}
    for source in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == source), key=lambda r: (r[2] % 2**64, r[3]))
        words = sum(r[1] for r in own)
        whole = min(3, int(due[source] // words)) if words else 0
        out |= {r[3]: whole for r in own}
        room, waiting = due[source] - words * whole, [r for r in own if r[1] > 0] if whole < 3 else []
        while True:
            waiting = [r for r in waiting if r[1] <= room]
            taken = []
            for r in waiting:
                if sum(t[1] for t in taken) + r[1] > room:
                    break
                taken.append(r)
            if not taken:
                break
            room -= sum(t[1] for t in taken)
            out |= {t[3]: whole + 1 for t in taken}
            waiting = [r for r in waiting if r not in taken]
        left = [r for r in own if r[1] > 0 and out[r[3]] == whole] if whole < 3 else []
        if left and (last := min(left, key=lambda r: (r[1], r[2] % 2**64)))[1] < 2 * room:
            out[last[3]] = whole + 1
    return out


def test_selection_by_brute_force(spark):
    """A hot id, equal rows, rows without ids and a source named like nothing else, one by one."""
    rng = random.Random(12)
    text = lambda n: " ".join(["w"] * n)
    rows = [(5, text(rng.randint(1, 40)), "a") for _ in range(60)] + [(5, "same words here", "a")] * 25 + [(None, "none of these", None)] * 40
    rows += [(k, text(rng.choice([1, 2, 5, 30, 400])), rng.choice(["a", "b", "\0", None])) for k in range(400)]
    docs = spark.createDataFrame([(*r, 1, 2, "r") for r in rows], "doc_id long, text string, source string, row_key int, row_number int, piece string").repartition(6)
    got = mixing.mix_sources(docs).withColumn("spot", mixing.F.xxhash64(mixing.F.lit(mixing.SEED), "row_key")).collect()
    assert len({r.row_key for r in got}) == len(got) == len(rows)
    due = {r.source: r.target for r in got}
    want = plain_mix([(r.source, r.size, r.spot, r.row_key) for r in got], due)
    assert {r.row_key: r.repeats for r in got} == want
    assert all(abs(due[s] - sum(r.taken for r in got if r.source == s)) <= 0.02 * due[s] for s in due)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "repeats"]
    words = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + r.repeats * len(r.text.split())
        assert (r.row_key, r.row_number, r.piece) == (1, 2, "r")
    assert words == {s: n for s in due if (n := sum(r.taken for r in got if r.source == s))}
