"""SimHash against all pairs of fingerprints, each recomputed word by word."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from maskwright.llm import simhash
from tests.llm.test_minhash import drifting_copies


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, prints):
    low = dict(zip(ids, ids))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = find(ids[a]), find(ids[b])
                low[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [simhash.BLOCK, 4])
def test_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    texts = drifting_copies() + ["x " * 9000, "A\x0bB c d", "1 2 3"]
    ids = list(range(500, 500 + len(texts)))
    random.Random(3).shuffle(ids)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, bits int, component string").repartition(5)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = [fingerprint(t) for t in texts]
    want = classes(ids, prints)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in zip(ids, prints)}
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(set(prints))


@pytest.mark.parametrize("block", [simhash.BLOCK, 8])
def test_fingerprints_near_and_just_beyond(spark, monkeypatch, block):
    """Clouds around a few centres, chains of four bits, pairs of five bits, and one segment that a third of all share."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(9)
    flipped = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        prints |= {flipped(centre, rng.randint(0, 7)) for _ in range(60)}
        for _ in range(10):
            prints.add(centre := flipped(centre, 4))
        prints |= {flipped(flipped(centre, 5), 0)}
    prints |= {rng.getrandbits(43) << 21 | 77 for _ in range(200)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {r.bits: r.component for r in simhash.components_of(spark.createDataFrame([(s,) for s in signed], "bits long")).collect()}
    assert got == classes(signed, prints)


def test_odd_rows(spark):
    rows = [(7, None), (3, ""), (3, ""), (None, " \n"), (5, "one two three four five"), (None, "One TWO three four five"), (None, "no id has these words at all, none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.fingerprint == "0" * 16, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == [("3", True, "3"), ("3", True, "3"), ("5", False, "5"), ("7", True, "3"), ("None", False, "5"), ("None", False, "None"), ("None", True, "3")]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_hash_is_that_of_spark(spark):
    text = "Some words, é 中"
    own = spark.range(1).select(F.xxhash64(F.lit("some words, é 中"))).first()[0]
    assert simhash._fingerprint(text) == own
