"""Fingerprints against a plain loop, and their algebra."""

import hashlib

import numpy as np

from maskwright.llm import multiset
from tests.session import make_session  # noqa: F401

SF = "/root/testdata/sf0.001"


def expected(rows):
    """Ids, sizes and edited hashes of (doc_id, text) rows, in order."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest()))
    return out


def check(spark, rows, pieces=3):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, stretch int").repartition(pieces)
    got = multiset.fingerprints(docs).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=key) == sorted(expected(rows), key=key)
    return got


def test_documents_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 7)
    long_ones = [r for r in got if r.n_chars > 400]
    assert np.mean([r.near_edited for r in long_ones]) > 0.65 and np.mean([r.near_next for r in long_ones]) < 0.2
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_hard_rows(spark):
    rows = [(None, None), (None, "null id"), (3, "é" * 9 + "\n\n" + "x y"), (3, ""), (5, "one"), (5, "one"), (9, "a b c d e f g\n" * 40), (-4, "\n"), (11, "one")]
    got = check(spark, rows)
    same = {r.fingerprint for r in got if r.n_chars == 3}
    assert len(same) == 1
    check(spark, [(1, "alone in here")])
    assert multiset.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sums():
    v = lambda *t: multiset.vectors(list(t))
    a, b, both, turned = v("one two three four"), v("five six seven"), v("one two three four\nfive six seven"), v("five six seven\none two three four")
    equal = lambda x, y: (x[0] == y[0]).all() and (x[1] == y[1]).all()
    assert equal(both, turned) and equal(multiset.combined(a, b), both) and equal(multiset.combined(both, b, delete=True), a)
    assert multiset.likeness(both, turned)[0] == 1 and multiset.likeness(a, b)[0] < 0.5
    assert not equal(v("a\nb"), v("a b")) and not equal(v("a"), v("a\n")) and equal(v(""), v(""))
    lone = v("x\ny", "", "\n\n", "last")
    assert all(equal((lone[0][k : k + 1], lone[1][k : k + 1]), v(t)) for k, t in enumerate(["x\ny", "", "\n\n", "last"]))
