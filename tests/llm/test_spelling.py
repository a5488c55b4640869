"""Spelling variants against all pairs of words, edit by edit."""

import random
import re
import zlib
from collections import Counter

import pytest

from maskwright.llm import spelling


def counted(rows):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] and max(n[v] for v in near[w]) >= 2 * n[w] else None for w in n}
    root = {}
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return {(w, form[w], root[w], n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def variants(seed=5, words=260):
    rng = random.Random(seed)
    out = []
    for _ in range(words):
        base = "".join(rng.choice("abé") for _ in range(rng.randint(4, 9)))
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(base) + 1)
            out += [rng.choice([base, base[:at] + base[at + 1 :], base[:at] + "b" + base[at:], base[:at] + "É" + base[at + 1 :], base.upper()])] * rng.choice([1, 2, 3, 8, 25])
    rng.shuffle(out)
    return [(k if k % 9 else None, rng.choice(" ,;1中\n").join(out[k :: 40])) for k in range(40)]


@pytest.mark.parametrize("block, gathered", [(spelling.BLOCK, spelling.GATHERED), (3, 7)])
def test_against_all_pairs(spark, monkeypatch, block, gathered):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "GATHERED", gathered)
    rows = [*variants(), (1, None), (2, ""), (3, "a b")]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, word string, n long").repartition(5)
    got = [tuple(r) for r in spelling.spelling_variants(docs).collect()]
    want = expected(counted(rows))
    assert len(want) > 200 and any(f and f != r for _, f, r, *_ in want)
    assert len(got) == len(set(got)) and set(got) == want


def test_long_runs_repeats_and_empty_tables(spark):
    long = "".join(random.Random(1).choice("abcdef") for _ in range(60_000))
    rows = [(1, " ".join([long] * 3 + [long[:500] + long[501:]] * 7)), (1, "Café café cafe cafés" * 1), (1, "Café café cafe cafés" * 1), (4, "cafés cafés")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in spelling.spelling_variants(docs).collect()} == expected(counted(rows))
    assert spelling.spelling_variants(docs.where("false")).count() == 0


def test_a_key_shared_by_a_third_of_all_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 16)
    letters = "abcdefghij"
    words = [f"same{x}{y}" for x in letters for y in letters] + [f"{x}{y}{z}other" for x in letters[:5] for y in letters[:6] for z in letters[:7]]
    frame = spark.createDataFrame([(w, 3 + k % 7) for k, w in enumerate(words)], "word string, n long")
    n = {w: 3 + k % 7 for k, w in enumerate(words)}
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(frame).collect()}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    assert got == {w: (len(v), n[b := min(v, key=lambda x: (-n[x], x))], b) for w, v in near.items() if v}
