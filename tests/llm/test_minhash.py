"""Near-duplicate classes against all pairs; registers against their definition."""

import random

import numpy as np
import pytest

from maskwright.llm import graph, minhash
from maskwright.llm.bytesops import shingle_sets, text_chunks


def sets_of(texts):
    out = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        out.append({" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set()))
    return out


def components(ids, sets, percent=85):
    low = dict(zip(ids, ids))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                low[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def drifting_copies(seed=4):
    """Chains of copies in which each changes a few words of an earlier one, among other texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7)))
    texts = [None, "", " \n\t", "One", "one", "two words", "TWO\nwords", "é É", "a b c d", "a b c d e"]
    for _ in range(3):
        grown = [[word() for _ in range(120)]]
        for _ in range(60):
            copy = list(rng.choice(grown))
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            grown.append(copy)
        texts += [" ".join(c) for c in grown]
    texts += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(60)]
    return texts


@pytest.mark.parametrize("block", [minhash.BLOCK, 7])
def test_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = drifting_copies()
    ids = list(range(1000, 1000 + len(texts)))
    random.Random(1).shuffle(ids)
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in zip(ids, texts)], "doc_id long, text string, key int, registers string").repartition(6)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    sets = sets_of(texts)
    want = components(ids, sets)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(s) and got[i].kept == (want[i] == i) for i, s in zip(ids, sets))


def test_empty_table_repeated_rows_null_ids_and_ties(spark):
    text = "the same seven words stand here twice"
    docs = spark.createDataFrame([(4, text), (4, text), (2, text.upper()), (None, text), (None, None), (9, "")], "doc_id long, text string")
    rows = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(docs).collect())
    assert rows == [("2", "2", True), ("4", "2", False), ("4", "2", False), ("9", "9", True), ("None", "2", False), ("None", "None", False)]
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(8)
    all_hashes = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.sort(all_hashes[:1900]), np.sort(all_hashes[100:2000])
    one = lambda x: minhash.registers(x, np.array([0, len(x)]))[0]
    union = one(np.unique(np.concatenate([a, b])))
    assert (np.maximum(one(a), one(b)) == union).all()
    rows = lambda x: one(x)[None, :]
    size = np.array([1900.0])
    assert minhash.joint_likely(rows(a), rows(b), size, size, 0.85)[0]
    assert not minhash.joint_likely(rows(a), rows(np.sort(all_hashes[1000:2900])), size, size, 0.85)[0]


def test_components_of_a_path(spark):
    order = list(range(60))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([*zip(order[:40], order[1:41]), (70, 70), (81, 80)], "a long, b long")
    got = {r.doc_id: r.component_id for r in graph.connected_components(links).collect()}
    assert got == {i: min(order[:41]) for i in order[:41]} | {80: 80, 81: 80}


def test_shingles_of_short_and_empty_texts():
    import pyarrow as pa

    texts = ["", "a", "a b c d e", None, "A  b\tc d e", "a b c d e a b c d e"]
    (_, _, raw, offsets), = text_chunks(pa.array(texts))
    members, ends = shingle_sets(raw, offsets)
    assert np.diff(ends).tolist() == [0, 1, 1, 0, 1, 5]
    assert members[ends[2]] == members[ends[4]]
