"""Long repeats against a brute-force search, and the sort against Python's."""

import hashlib
import random

import numpy as np
import pytest

from maskwright.llm import suffix


def brute(texts):
    """Removed bytes of every text, by counting all 400-byte strings."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for s in range(len(r) - suffix.LENGTH + 1):
            seen[r[s : s + suffix.LENGTH]] = seen.get(r[s : s + suffix.LENGTH], 0) + 1
    out = []
    for r in raws:
        flags = [False] * len(r)
        for s in range(len(r) - suffix.LENGTH + 1):
            if seen[r[s : s + suffix.LENGTH]] > 1:
                flags[s : s + suffix.LENGTH] = [True] * suffix.LENGTH
        spans = sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags))
        out.append((len(r), sum(flags), spans, hashlib.sha256(bytes(b for b, f in zip(r, flags) if not f)).hexdigest()))
    return out


def hard_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    base = " ".join(word() for _ in range(500))
    out = [None, "", "a", "x" * 399, "x" * 400, "x" * 900, "y" * 401, base, base, "ab" * 700]
    for cut in (399, 400, 401, 584, 585, 600):
        at = rng.randint(0, 500)
        out.append(" ".join(word() for _ in range(rng.randint(0, 60))) + base[at : at + cut] + " ".join(word() for _ in range(rng.randint(0, 60))))
    for _ in range(30):  # copies with changed words
        copy = base.split(" ")
        for _ in range(rng.randint(1, 9)):
            copy[rng.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    part = base[700:1300]
    out.append(part + "--" + part[50:] + "==" + part)
    return out


@pytest.mark.parametrize("limit", [suffix.GROUP_LIMIT, 3])
def test_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix, "GROUP_LIMIT", limit)
    texts = hard_texts()
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, core int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs).collect()}
    want = dict(enumerate(brute(texts)))
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}


def test_empty_table_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "q" * 400), (1, "q" * 400), (None, "z" * 400)], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.n_removed) for r in suffix.remove_repeats(docs).collect())
    assert rows == [(-1, 0), (1, 400), (1, 400)]
    assert suffix.remove_repeats(docs.where("false")).count() == 0


@pytest.mark.parametrize("limit", [suffix.GROUP_LIMIT, 3])
def test_partly_shared_passages_of_rows_without_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix, "GROUP_LIMIT", limit)
    texts = hard_texts()
    ids = [None if k % 3 else k for k in range(len(texts))]
    docs = spark.createDataFrame([(i, t) for i, t in zip(ids, texts)], "doc_id long, text string").repartition(5)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs).collect())
    assert got == sorted((str(i), *b) for i, b in zip(ids, brute(texts)))


def test_order_is_that_of_sorted_rows():
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 20, 3000))
    rows = rng.integers(0, 2, (3000, 61)).astype(np.uint8)
    rows[:, :40] = 7
    rows[rng.random(3000) < 0.4] = rows[0]
    order = suffix.deep_shallow_order(group, rows)
    keys = [(int(group[i]), rows[i].tobytes()) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(3000))
